"""Codec, token counts, license scans, quality rules, URL filters, mixing."""

import hashlib
import os
import random
import re
import textwrap
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from derivia.llm import license_scan, mixing, piece_codec, quality_rules, token_counts, url_filters
from derivia.llm.queries import tokenizer_file, tokenizer_pattern

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELLED = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "  a b", "a\n\tb　x＠é▁c", "▁▁a\x00b\n", "<s> </s><0x41>", "x" * 1000, "ab " * 300, "日本語テキスト😀 👍🏽", "퟿\U0010ffff", "trail ", "é" * 700 + " z"]


def random_texts(n=300):
    rng = random.Random(1)
    return ["".join(rng.choice("ab  etho n▁\n日é😀rsx1") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_is_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.load(path)
    texts = TEXTS + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in piece_codec.coded(df, path, with_ids=True, with_text=True).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == sha(r.decoded)
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 0, 1]) for _ in range(rng.randint(0, 12))]
        assert ours.decode(ids) == library.decode(ids)
    assert piece_codec.coded(df.limit(0), path).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoder = token_counts.Encoder(path, tokenizer_pattern())
    texts = TEXTS + random_texts(60)
    got = token_counts.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, tokenizer_pattern(), rule=rule).collect()
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        lines = raw.decode().split("\n")
        bounds, at = [], 0
        for k, line in enumerate(lines):
            end = at + len(line.encode()) + (k < len(lines) - 1)
            bounds.append((at, end))
            at = end
        bounds = [b for b in bounds if b[1] > b[0]] or [(0, 0)]
        counts, start = [0] * len(bounds), 0
        for t in encoder.encoding.encode_ordinary(text or ""):
            end = start + len(encoder.encoding.decode_single_token_bytes(t))
            share = [max(0, min(end, b) - max(start, a)) for a, b in bounds]
            inside = [k for k, s in enumerate(share) if s]
            counts[inside[0] if rule == "start" else inside[-1] if rule == "end" else int(np.argmax(share))] += 1
            start = end
        mine = sorted((r.section, r.n_tokens, r.n_bytes) for r in got if r.doc_id == i)
        assert mine == [(k, counts[k], b - a) for k, (a, b) in enumerate(bounds)]


LICENSES = {k: v[0] for k, v in license_scan.TEMPLATES.items()}
WORDINGS = [(k, x) for k, v in license_scan.TEMPLATES.items() for x in v]


def test_license_scan(spark):
    t = LICENSES
    docs = [
        (0, None), (1, ""), (2, "plain words\nand more"), (3, "our permission to license nothing here"), (4, f"code\n{t['MIT']}\nmore code"),
        (5, "head\nLicensed under CC BY-NC 4.0.\ntail"), (6, "\n".join([t["Apache-2.0"].replace("you may not", "you really may not"), "x", "y", "Released under the MIT License."])), (7, "license " * 3000),
        (8, "word " * 30_000 + t["ISC"]), (4, f"code\n{t['MIT']}\nmore code"),
    ]
    frame = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, first_line int, license string")
    got = sorted((r.doc_id, r.first_line, r.license, r.n_missing, r.n_added) for r in license_scan.scanned(frame).collect())
    assert got == [(4, 1, "MIT", 0, 0)] * 2 + [(5, 1, "CC-BY-NC-4.0-notice", 0, 0), (6, 0, "Apache-2.0", 0, 1), (6, 3, "MIT-notice", 0, 0), (8, 0, "ISC", 0, 0)]
    assert license_scan.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("columns", [40, 72, 80])
@pytest.mark.parametrize("mark", ["", "# "])
def test_license_scan_of_wrapped_texts(columns, mark):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, template in WORDINGS:
        lines = textwrap.wrap(template, columns, initial_indent=mark, subsequent_indent=mark)
        for before in ([], ["some plain words of a text"] * 9):
            got = scanner.scan("\n".join([*before, *lines, "", "more plain words"]))
            assert [x[:3] for x in got] == [(len(before), len(before) + len(lines) - 1, name)]


def test_license_scan_of_neighbours():
    t = LICENSES
    parts = [t["ISC"], t["ISC"].replace("for any purpose", "for each purpose"), t["MIT-notice"], t["MIT-notice"], t["MPL-2.0"]]
    got = license_scan.Scanner(license_scan.TEMPLATES).scan("\n".join(parts))
    assert [(*x[:3], x[4]) for x in got] == [(0, 0, "ISC", 0), (1, 1, "ISC", 1), (2, 2, "MIT-notice", 0), (3, 3, "MIT-notice", 0), (4, 4, "MPL-2.0", 0)]


@pytest.mark.parametrize(("text", "names"), [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This work is licensed under the GNU Affero General Public License, version 3.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
    (LICENSES["GPL-3.0-or-later"].replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
    (LICENSES["GPL-3.0-or-later"].replace("version 3", "version 4"), []),
    (LICENSES["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General"), ["AGPL-3.0-or-later"]),
    (LICENSES["GPL-3.0-or-later"].replace("GNU General", "GNU Lesser General"), ["LGPL-3.0-or-later"]),
    (LICENSES["AGPL-3.0-or-later"].replace("Affero ", ""), ["GPL-3.0-or-later"]),
    (LICENSES["LGPL-2.1-or-later"], ["LGPL-2.1-or-later"]),
    (LICENSES["LGPL-2.1-or-later"].replace("2.1", "2.2"), []),
    (LICENSES["LGPL-2.0-or-later"].replace("Library General", "Lesser General"), []),
    (LICENSES["Apache-2.0"].replace("Version 2.0", "Version 1.1"), []),
    (LICENSES["Apache-1.1"], ["Apache-1.1"]),
    (LICENSES["MPL-2.0"].replace("2.0", "1.1"), []),
    ("Licensed under CC BY 3.0.", []),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0-notice"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-notice"]),
    ("Licensed under CC BY, surely, 4.0.", []),
    ("Released under the X11 License.", []),
    ("Released under the MIT X11 License.", []),
    ("Released under the terms of the MIT License.", ["MIT-notice"]),
    (LICENSES["BSD-2-Clause"], ["BSD-2-Clause"]),
    (LICENSES["BSD-3-Clause"], ["BSD-3-Clause"]),
    (LICENSES["BSD-3-Clause"].replace("copyright holder nor", "University nor"), ["BSD-3-Clause"]),
])
def test_license_scan_tells_relatives_apart(text, names):
    found = license_scan.Scanner(license_scan.TEMPLATES).scan(f"some code\n{text}\nmore code")
    assert [x[2] for x in found] == names


def test_license_scan_against_brute_force():
    """Every exact wording is found; and a finding's words hold its template's in order, by dynamic programming, but for what is allowed."""
    rng, scanner = random.Random(4), license_scan.Scanner(license_scan.TEMPLATES)
    plain = "the software is provided under a license of any kind by version 2 or 3 general public words".split()

    def most_in_order(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last, row = row, [0]
            for j, b in enumerate(y):
                row.append(last[j] + 1 if a == b else max(last[j + 1], row[-1]))
        return row[-1]

    for _ in range(60):
        lines, planted = [], []
        for _ in range(rng.randint(1, 4)):
            lines.append(" ".join(rng.choices(plain, k=rng.randint(0, 40))))
            name, words = rng.choice(WORDINGS)
            words = words.split()
            exact = rng.random() < 0.5
            for _ in range(0 if exact else rng.randint(1, 8)):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 2)] = rng.choices(plain, k=rng.randint(0, 2))
            if exact:
                planted.append((len(lines), name))
            lines.append(" ".join(words) or "x")
        found = scanner.scan("\n".join(lines))
        assert {(x[0], x[2]) for x in found} >= set(planted)
        for first, last, name, _, missing, added in found:
            text = license_scan.wording("\n".join(lines[first : last + 1]))
            fits = [w for k, v in WORDINGS if k == name for w in [license_scan.wording(v)] if missing <= 0.1 * len(w) and added <= max(4, 0.2 * len(w)) and most_in_order(text, w) >= len(w) - missing]
            assert fits


def statistics(text):
    w = WORD.findall(text or "")
    first, hit = {}, set()
    for i in range(len(w) - 2):
        k = tuple(w[i : i + 3])
        if k in first:
            hit |= {*range(i, i + 3), *range(first[k], first[k] + 3)}
        first.setdefault(k, i)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics_and_base_rule(spark):
    texts = TEXTS + random_texts(100) + ["a b c " * 30, "x\nx\n x\n\n\nx", "a b c d a b c", "a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    for r in quality_rules.judged(df, quality_rules.DecisionList(())).collect():
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_learned_list(spark):
    rng = np.random.default_rng(0)
    rows = rng.uniform(0, 1, (3000, 2))
    bad = (rows[:, 0] > 0.8) | ((rows[:, 0] < 0.2) & (rows[:, 1] > 0.5))
    found = quality_rules.sequential_covering(rows, bad, np.arange(3000) % 3 == 0, ["a", "b"])
    fresh = rng.uniform(0, 1, (2000, 2))
    truth = (fresh[:, 0] > 0.8) | ((fresh[:, 0] < 0.2) & (fresh[:, 1] > 0.5))
    assert (found.rejects(fresh, ["a", "b"]) == truth).mean() > 0.98 and len(found.rules) >= 2
    df = spark.createDataFrame(fresh.tolist(), "a double, b double")
    kept = [r[0] for r in df.select(found.kept({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert (np.array(kept) == ~found.rejects(fresh, ["a", "b"])).all()
    for flag in (True, False):  # nothing to tell apart
        assert not quality_rules.sequential_covering(rows, np.full(3000, flag), np.arange(3000) % 3 == 0, ["a", "b"]).rules
    empty = quality_rules.learn(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert not empty.rules


def test_learned_from_labels(spark):
    good = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"w{i}###" for i in range(80))
    docs = spark.createDataFrame([(i, noisy + f" t{i}" if i % 4 == 0 else good + f" t{i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 0), (3, None)], "doc_id long, quality int"))
    rules = quality_rules.learn(docs, labels)
    assert {r.doc_id for r in quality_rules.judged(docs, rules).filter("not kept").collect()} == set(range(0, 200, 4))


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="needs the driver's tables")
def test_learned_list_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rules = quality_rules.learn(docs, labels.filter(~held))
    out = quality_rules.judged(docs.join(labels.filter(held), "doc_id"), rules).filter("not base_failed")
    bad, rejected, both = out.agg(F.expr("count_if(quality = 0)"), F.expr("count_if(not kept)"), F.expr("count_if(quality = 0 and not kept)")).first()
    assert both >= 0.9 * rejected and both >= 0.7 * bad > 0


def test_labels_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text)] * 50 + [(1, text + " ###"), (2, None), (None, text)], "doc_id long, text string")
    rules = quality_rules.learn(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int"))
    assert quality_rules.judged(docs, rules).filter("kept").count() == 52


def test_url_filter(spark):
    entries = [("bad.com", "block", date(2024, 1, 10)), ("bad.com", "remove", date(2024, 2, 1)), ("bad.com/ok", "allow", date(2024, 1, 1)), ("a.bad.com", "allow", date(2024, 1, 20)), (None, "block", date(2024, 1, 1)), ("com", "block", date(2024, 1, 1))]
    pages = [
        (1, "http://bad.com/x", date(2024, 1, 9), False, None), (2, "HTTP://Bad.com:80/x?y#z", date(2024, 1, 10), True, "bad.com"), (3, "https://u@bad.com/ok/1", date(2024, 1, 15), False, "bad.com/ok"),
        (4, "http://a.bad.com", date(2024, 1, 15), True, "bad.com"), (5, "http://a.bad.com", date(2024, 1, 25), False, "a.bad.com"), (6, "http://bad.com", date(2024, 2, 1), False, None),
        (7, None, date(2024, 1, 15), False, None), (8, "no url", date(2024, 1, 15), False, None), (9, "http://bad.com", None, False, None), (10, "http://x.notbad.com", date(2024, 1, 15), False, None),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, fetched_at date").withColumn("key", F.lit("clash"))
    got = url_filters.filtered(df, spark.createDataFrame(entries, "key string, action string, listed_at date")).collect()
    assert sorted((r.page_id, r.blocked, r.rule) for r in got) == [(p[0], p[3], p[4]) for p in pages]
    assert url_filters.filtered(df.limit(0), spark.createDataFrame(entries, "key string, action string, listed_at date")).count() == 0


def test_url_filter_meets_deep_entries(spark):
    entries = [("bad.com/a/b", "block", date(2024, 1, 1)), ("bad.com/a/b/c/d/e", "allow", date(2024, 1, 1)), ("bad.com/a/b/c/d/e/f/g", "block", date(2024, 1, 1))]
    urls = ["http://bad.com/a/b/c/d", "http://bad.com/a/b/c/d/e?q", "http://bad.com/a/b/c/d/e/f", "http://bad.com/a/b/c/d/e/f/g/h/i"]
    df = spark.createDataFrame([(i, u, date(2024, 1, 2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    got = url_filters.filtered(df, spark.createDataFrame(entries, "key string, action string, listed_at date")).collect()
    assert sorted((r.page_id, r.blocked, r.rule) for r in got) == [(0, True, "bad.com/a/b"), (1, False, "bad.com/a/b/c/d/e"), (2, False, "bad.com/a/b/c/d/e"), (3, True, "bad.com/a/b/c/d/e/f/g")]


def test_url_filter_of_addresses_and_ties(spark):
    day = date(2024, 1, 1)
    entries = [("[2001:db8::1]", "block", day), ("[2001:db8::1]/ok", "allow", day), ("3.4", "block", day), ("1.2.3.4", "block", day), ("tie.com", "allow", day), ("tie.com", "block", day), ("gone.com", "block", day), ("gone.com", "remove", day)]
    urls = {"http://[2001:DB8::1]:80/x": True, "http://u@[2001:db8::1]/ok": False, "http://[2001:db8::2]/": False, "http://1.2.3.4/": True, "http://9.2.3.4/": False, "http://tie.com": True, "http://gone.com": False, "http://tie.com/" + "x/" * 3000: True}
    df = spark.createDataFrame([(i, u, date(2024, 1, 2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    got = url_filters.filtered(df, spark.createDataFrame(entries, "key string, action string, listed_at date")).collect()
    assert [r.blocked for r in sorted(got)] == list(urls.values())


@pytest.mark.parametrize("run", [2, 10_000])
def test_url_filter_keeps_every_capture(spark, monkeypatch, run):
    monkeypatch.setattr(url_filters, "RUN", run, raising=False)
    bad, ok, day = "http://bad.com/a/b", "http://bad.com/ok/x", date(2024, 1, 2)
    rows = [(1, bad, day)] * 3 + [(1, ok, day), (1, bad, None), (2, bad, day)] + [(None, bad, day)] * 4 + [(None, ok, day)] * 5 + [(None, bad, None)] * 2 + [(None, None, None)] * 3 + [(3, "no url", day)] * 2
    entries = [("bad.com", "block", date(2024, 1, 1)), ("bad.com/ok", "allow", date(2024, 1, 1))]
    rule = lambda url, at: ("bad.com" if url == bad else "bad.com/ok" if url == ok else None) if at else None
    want = [(i, at, rule(url, at) == "bad.com", rule(url, at)) for i, url, at in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at date")
    got = url_filters.filtered(df, spark.createDataFrame(entries, "key string, action string, listed_at date")).collect()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.fetched_at, r.blocked, r.rule)) for r in got)


def water(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "b", "ä", "Z", None] + ["hot"] * 5), rng.choice([0, 1, 5, 40, None])) for i in range(400)] + [(401, "tiny", 0), (1, "a", 5), (None, "b", 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, words long").withColumn("size", F.lit("clash"))
    got = mixing.mix(df, size=F.col("words"), ranges=8).collect()
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = water(sizes, (3, 1, 2), 1.5, 2.0)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(df.repartition(7), size=F.col("words"), ranges=8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(df.limit(0), size=F.col("words")).count() == 0


def test_mix_of_many_sources(spark):
    """Sources in several ranges have the targets that they have in one."""
    rng = random.Random(5)
    sizes = {f"s{i}": rng.randint(0, 500) for i in range(300)} | {None: 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    want = water(sizes, (3, 1, 2), 1.5, 2.0)
    for most_in_order in (17, 1000):
        got = {r.source: r.target for r in mixing.source_targets(frame, (3, 1, 2), 1.5, 2.0, most_in_order).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, f" w{i}\n" + "x " * (i % 9), "en", "ab"[i % 2], 5) for i in range(60)] + [(99, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.schema == docs.schema
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    want = {r.doc_id: r.taken for r in mixing.mix(docs, size=F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).collect() if r.taken}
    assert words == want
