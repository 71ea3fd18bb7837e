"""Data contracts of model calls: messages, label masks, batches, and pluggable batch functions.

The engine has no model of its own. A model is any function from a list of
prompts to a list of texts; it runs within Arrow batches, with retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.schema import PROMPT_HIDDEN

BATCH, ATTEMPTS, DELAY = 32, 5, 2.0
IGNORED = -100
#: Own wording; the contract is the five fields and that nothing is invented.
SYSTEM = "Extract the facts of the statement as one JSON object with the fields chief_complaint, symptoms, medications, allergies and missing_information. State nothing that is not said."
JUDGE = "Case: %s\nLanguage: %s\nStatement: %s\nDoes the statement say exactly what the case says, in this language? Answer with semantic_passed, language_passed, semantic_errors and language_errors as JSON."

UTTERANCE = "Say in %s, in one or two plain sentences of a patient, exactly what this case says and nothing else: %s"


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Chat messages: array of (role, content)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [turn("system", system), turn("user", user)] + ([turn("assistant", assistant)] if assistant is not None else [])
    return F.array(*turns)


def compact_json(target: Column) -> Column:
    """Compact JSON of a struct, its fields in order, with nulls."""
    return F.to_json(target, {"ignoreNullFields": "false"})


def pretty_json(target: Column) -> Column:
    return F.to_json(target, {"ignoreNullFields": "false", "pretty": "true"})


def training_messages(samples: DataFrame) -> DataFrame:
    """``samples`` with ``messages``: system, the utterance, the target as compact JSON."""
    return samples.withColumn("messages", messages(F.lit(SYSTEM), F.col("utterance"), compact_json(F.col("target"))))


def judge_prompt(case: Column, language: Column, utterance: Column) -> Column:
    return F.format_string(JUDGE, case, language, utterance)


def prompt_case(cases: DataFrame) -> list[str]:
    """The columns of a case that a model may see: all but ids, split, pattern and group."""
    return [c for c in cases.columns if c not in PROMPT_HIDDEN]


def utterance_prompt(cases: DataFrame, language: Column) -> Column:
    """What a model is asked to say as a patient would: the visible fields of a case as compact JSON, and the language."""
    return F.format_string(UTTERANCE, language, compact_json(F.struct(*prompt_case(cases))))


def mask_labels(tokens: Column, prompt_tokens: Column) -> Column:
    """Labels of a token list: those of the prompt are ignored."""
    return F.transform(tokens, lambda t, i: F.when(i < prompt_tokens, F.lit(IGNORED)).otherwise(t))


def unquote(c: Column) -> Column:
    """Strips one pair of wrapping double quotes."""
    return F.regexp_replace(F.trim(c), r'(?s)^"(.*)"$', "$1")


def with_retries(call: Callable[[list[str]], list[str]], attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """The call, tried again after growing pauses; the last failure is raised."""

    def run(prompts: list[str]) -> list[str]:
        for attempt in range(attempts):
            try:
                return call(prompts)
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(delay * 2**attempt)
        return []

    return run


def generate(df: DataFrame, prompt: str, out: str, call: Callable[[list[str]], list[str]], batch: int = BATCH, attempts: int = ATTEMPTS, delay: float = DELAY, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``out``: the model's text for each prompt, asked in batches within each task. Every prompt must get one answer.

    Beside the Arrow batch as it came, which isn't copied, a worker holds the
    prompts and answers of one call only.
    """
    columns = [c for c in df.columns if c != out]
    kept = [c for c in columns if keep is None or c in keep]
    schema = ", ".join(f"`{c}` {k}" for c, k in df.select(*kept).dtypes) + f", `{out}` string"
    asked = with_retries(call, attempts, delay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                prompts = part.column(columns.index(prompt)).to_pylist()
                got = asked(prompts)
                if len(got) != len(prompts):
                    raise ValueError(f"{len(prompts)} prompts got {len(got)} answers")
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in kept], pa.array(got, pa.string())], [*kept, out])

    return df.select(*columns).mapInArrow(run, schema)


def aligned(inputs: DataFrame, outputs: DataFrame, ordinal: str, key: tuple[str, ...]) -> DataFrame:
    """Ordinals whose input and output differ in a key, or that only one side has."""
    a = inputs.select(ordinal, F.struct(*key).alias("_a"))
    b = outputs.select(ordinal, F.struct(*key).alias("_b"))
    return a.join(b, ordinal, "full").where("not _a <=> _b").select(ordinal)


def structure_intake(df: DataFrame, call: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """Batch form of the intake service: (text, language) to ``result`` (target type, missing fields derived anew) and ``error``.

    Answers must be bare JSON; extra fields are ignored; whole numbers may be
    written as text or with a point.
    """
    from caseframe.functions import jsonvalue as j
    from caseframe.functions.normalize import with_derived_missing
    from caseframe.schema import TARGET

    asked = generate(df, text, "_raw", call).withColumn("_v", j.strict_object(F.trim("_raw")))
    cast = F.try_variant_get("_v", "$", TARGET)
    sound = cast.isNotNull()
    for field in ("chief_complaint", "symptoms", "medications", "allergies", "missing_information"):
        sound = sound & cast[field].isNotNull()
    staged = asked.withColumn("_ok", F.coalesce(sound, F.lit(False))).withColumn("_r", cast)
    result = F.when(F.col("_ok"), with_derived_missing(F.col("_r")))
    error = F.when(F.col("_v").isNull(), F.lit("invalid_json")).when(~F.col("_ok"), F.lit("invalid_fields"))
    return staged.select(*df.columns, result.alias("result"), error.alias("error"))
