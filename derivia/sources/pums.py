"""ACS PUMS microdata."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.parse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from derivia.sources.fetch import CACHE, fetch_url

# State names, their postal abbreviations and FIPS codes.
STATES = """
Alabama AL 01, Alaska AK 02, Arizona AZ 04, Arkansas AR 05, California CA 06, Colorado CO 08, Connecticut CT 09, Delaware DE 10,
District of Columbia DC 11, Florida FL 12, Georgia GA 13, Hawaii HI 15, Idaho ID 16, Illinois IL 17, Indiana IN 18, Iowa IA 19, Kansas KS 20,
Kentucky KY 21, Louisiana LA 22, Maine ME 23, Maryland MD 24, Massachusetts MA 25, Michigan MI 26, Minnesota MN 27, Mississippi MS 28,
Missouri MO 29, Montana MT 30, Nebraska NE 31, Nevada NV 32, New Hampshire NH 33, New Jersey NJ 34, New Mexico NM 35, New York NY 36,
North Carolina NC 37, North Dakota ND 38, Ohio OH 39, Oklahoma OK 40, Oregon OR 41, Pennsylvania PA 42, Rhode Island RI 44,
South Carolina SC 45, South Dakota SD 46, Tennessee TN 47, Texas TX 48, Utah UT 49, Vermont VT 50, Virginia VA 51, Washington WA 53,
West Virginia WV 54, Wisconsin WI 55, Wyoming WY 56, Puerto Rico PR 72
"""
_CODES: dict[str, str] = {}
for _entry in STATES.split(","):
    *_name, _postal, _fips = _entry.split()
    _CODES |= {" ".join(_name).upper(): _fips, _postal: _fips, _fips: _fips}

API = "https://api.census.gov/data"
KEY = "CENSUS_API_KEY"
#: A folder with one of these is a project's root; a .env file is not looked for above it.
ROOT_MARKS = (".git", "pyproject.toml")


def resolve_state(state: str) -> str:
    """The two-digit FIPS code of a state, from code, postal abbreviation or name in any case."""
    text = state.strip().upper()
    code = _CODES.get(text.zfill(2) if text.isdigit() else text)
    if code is None:
        raise ValueError(f"{state!r} is no state: give its FIPS code, postal abbreviation or name, e.g. '36', 'NY' or 'New York'")
    return code


def resolve_api_key() -> str | None:
    """The key from the environment, else from the nearest .env file up to the project's root."""
    return os.environ[KEY] if KEY in os.environ else read_dotenv().get(KEY)


def read_dotenv(start: Path | None = None) -> dict[str, str]:
    """The assignments of the nearest .env file from a folder (the current one) up to the project's root."""
    start = start or Path.cwd()
    for folder in (start, *start.parents):
        file = folder / ".env"
        if file.exists():
            pairs = (line.strip().partition("=") for line in file.read_text().splitlines() if "=" in line and not line.strip().startswith("#"))
            out: dict[str, str] = {}
            for name, _, value in pairs:
                out.setdefault(name.strip(), value.strip())
            return out
        if any((folder / mark).exists() for mark in ROOT_MARKS):
            break
    return {}


def parse_pums(spark: SparkSession, payload: Sequence[Sequence[str]], variables: Sequence[str], url: str = "") -> DataFrame:
    """The variables as columns, from an array of arrays with the header first.

    A variable becomes a number only if all of its values are: long if whole, else double.
    """
    if not payload or len(payload) < 2:
        raise RuntimeError(f"ACS PUMS gave no rows for {url}: no record matches the geography, year, survey or variables")
    header, *rows = payload
    columns, kinds = [], []
    for v in variables:
        values = [r[header.index(v)] for r in rows]
        kind = "string"
        for cast, name in ((int, "bigint"), (float, "double")):
            try:
                values, kind = [cast(x) for x in values], name
                break
            except (TypeError, ValueError):
                continue
        columns.append(values)
        kinds.append(f"`{v}` {kind}")
    return spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(kinds))


def fetch_pums(spark: SparkSession, variables: Sequence[str], state: str, *, year: int = 2022, survey: str = "acs1", cache_dir: str | os.PathLike | None = CACHE / "pums", api_key: str | None = None) -> DataFrame:
    """Rows of the variables for a state. Answers are parsed before they are cached, by the digest of the request."""
    key = api_key or resolve_api_key()
    if not key:
        raise RuntimeError(f"{KEY} is not set: export it, or write {KEY}=... into a .env file; keys are free at https://api.census.gov/data/key_signup.html")
    url = f"{API}/{year}/acs/{survey}/pums?" + urllib.parse.urlencode({"get": ",".join(variables), "for": f"state:{resolve_state(state)}"})
    file = None if cache_dir is None else Path(cache_dir) / f"{hashlib.sha256(url.encode()).hexdigest()[:32]}.json"
    if file is not None and file.exists():
        return parse_pums(spark, json.loads(file.read_text()), variables, url)
    body = fetch_url(url, timeout=30, label="ACS PUMS", request_url=f"{url}&key={key}")
    try:
        payload = json.loads(body)
    except json.JSONDecodeError:
        raise RuntimeError(f"ACS PUMS answered {url} with something that is no JSON") from None
    frame = parse_pums(spark, payload, variables, url)
    if file is not None:
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(payload))
    return frame
