"""Quality rules for model answers, as arrays of problem texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.functions.text import yaml_blocks

#: Keys that a context may have.
CONTEXT_KEYS = ["enzymes", "substrates", "mutants", "organisms", "temperatures", "pHs", "solutions", "other"]


def answer_problems(answer: Column) -> Column:
    """Mixed time units, no block, comma-delimited lists, nested lists, unknown context keys."""
    text = F.array_join(yaml_blocks(answer), "\n")
    seconds, minutes = text.rlike(r"\bs\^-1"), text.rlike(r"\bmin\^-1")
    keys = F.regexp_extract_all(F.regexp_extract(text, r"(?ms)^context:\s*$(.*)", 1), F.lit(r"(?m)^  ([A-Za-z]+):"), F.lit(1))
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in CONTEXT_KEYS]))
    return F.array_compact(F.array(
        F.when(F.size(yaml_blocks(answer)) == 0, "no yaml"), F.when(seconds & minutes, "mixed s and min"),
        F.when(text.rlike(r"(?m)^\s*(?:synonyms|mutants|organisms|descriptor):[^;\n]*, [^;\n]*$"), "comma delimiters"), F.when(text.rlike(r"\[[^\]\n]*\["), "nested list"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown context keys: "), F.array_join(unknown, ", "))),
    ))


def identifier_problems(asked: Column, answered: Column, golden: Column) -> Column:
    """Identifiers answered but never given, and expected ones that are missing."""
    made_up, lost = F.array_except(answered, asked), F.array_except(golden, answered)
    return F.array_compact(F.array(
        F.when(F.size(made_up) > 0, F.concat(F.lit("not in the question: "), F.array_join(made_up, ", "))),
        F.when(F.size(lost) > 0, F.concat(F.lit("missing: "), F.array_join(lost, ", "))),
    ))


#: The beginning of an outdated question without documents, and what replaces it.
EMPTY_QUESTION = "No yaml available. Construct from scratch!\n```yaml\ncontext:\n    null\ndata:\n    null\n"
NEW_EMPTY_QUESTION = "No yaml available. Construct the output yaml directly.\n```yaml\ncontext:\nnull\ndata:\nnull\n```                    \n"


def finetune_check(question: Column, answer: Column) -> Column:
    """struct(question, problems) of a fine-tuning example: an outdated empty question is replaced, the answer gets the answers' rules."""
    return F.struct(F.when(question.contains(EMPTY_QUESTION), F.lit(NEW_EMPTY_QUESTION)).otherwise(question).alias("question"), answer_problems(answer).alias("problems"))


def explode_problems(answer: Column) -> Column:
    """A resolved answer with no block, a wild type or an organism in the enzyme's name, or a buffer among cofactors."""
    text = F.array_join(yaml_blocks(answer), "\n")
    return F.array_compact(F.array(
        F.when(F.size(yaml_blocks(answer)) == 0, "no yaml"), F.when(text.rlike(r"(?im)^\s*(?:- )?enzyme:.*(wild[- ]?type|\bWT\b)"), "wild type in enzyme"),
        F.when(text.rlike(r"(?m)^\s*(?:- )?enzyme:.*\b(?:E\. coli|Escherichia|Homo sapiens|human)\b"), "organism in enzyme"), F.when(text.rlike(r"(?im)^\s*(?:- )?cofactors:.*\bTris\b"), "buffer in cofactors"),
    ))
