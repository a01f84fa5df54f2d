"""Linked synthetic tables as Spark plans: declared schemas in, whole DataFrames out."""

from derivia.functions.derive import derive_id
from derivia.functions.rules import Choice, Conditional, Constant, Integer, Normal, PoolChoice, Rule, RuleConformanceError, Sequential, Uniform, check_rule
from derivia.operators.fidelity import FidelityReport, fidelity_report
from derivia.operators.generate import RuleGenerator
from derivia.operators.link import DeterministicLinker
from derivia.operators.noise import OCR, Missing, Noise, NoiseOp, Typo
from derivia.operators.structure import Declared, Empirical, Prior, StructureConfigError
from derivia.operators.synthesize import CARTSynthesizer
from derivia.plans.conformance import GeneratorConformanceError, SynthesizerConformanceError, check_generator, check_synthesizer
from derivia.plans.context import RunContext
from derivia.plans.deprecation import DeriviaDeprecationWarning
from derivia.plans.mode import Mode, ModeSchema
from derivia.plans.pipeline import Pipeline, PipelineResult
from derivia.plans.provenance import ProvenanceRecord, Tagged, cited, modeled, user
from derivia.plans.registry import available, register, resolve, unregister
from derivia.plans.schema import Entity, Identifier, PerEntity, PerEvent, PerPeriod, Schema, SchemaError, Table


__all__ = [
    "CARTSynthesizer", "Choice", "Conditional", "Constant", "Declared", "DeriviaDeprecationWarning", "DeterministicLinker", "Empirical", "Entity", "FidelityReport",
    "GeneratorConformanceError", "Identifier", "Integer", "Missing", "Mode", "ModeSchema", "Noise", "NoiseOp", "Normal", "OCR", "PerEntity", "PerEvent", "PerPeriod",
    "Pipeline", "PipelineResult", "PoolChoice", "Prior", "ProvenanceRecord", "Rule", "RuleConformanceError", "RuleGenerator", "RunContext", "Schema", "SchemaError",
    "Sequential", "StructureConfigError", "SynthesizerConformanceError", "Table", "Tagged", "Typo", "Uniform", "available", "check_generator", "check_rule",
    "check_synthesizer", "cited", "derive_id", "fidelity_report", "modeled", "register", "resolve", "unregister", "user",
]
