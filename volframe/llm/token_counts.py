"""Token counts of sections, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import read
from .tokenizing import SpanEncoder, groups, shared, texts_of, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
#: Who gets a token that crosses from one section to the next: the section of its first character, that of its last, or
#: the one with most of its characters, the earlier of two with as many.
RULES = ("first", "last", "most")


def line_ends(text: str) -> np.ndarray:
    """Where each line of a text ends, as character positions. A line has its \\n with it."""
    return np.cumsum([len(line) + 1 for line in text.split("\n")])


def _attributed(batches: Iterator[pa.RecordBatch], path: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder = shared(SpanEncoder, path)
    for batch in batches:
        sections = batch.column(2) if batch.num_columns > 2 else None
        for start, run in groups(texts_of(batch)):
            counts, _, first, after = encoder.encode(run)
            at = 0
            where, numbers, froms, tos, tokens, crossing = [], [], [], [], [], []
            for i, (text, n) in enumerate(zip(run, counts, strict=True)):
                cuts = line_ends(text) if sections is None else sections[start + i].as_py()
                ends = np.asarray(cuts if cuts is not None else [], np.int64)
                begin, end = first[at : at + n], after[at : at + n]
                at += n
                if not len(ends) or ends[-1] < len(text):
                    ends = np.append(ends, len(text))
                a = np.searchsorted(ends, begin, side="right")
                z = np.searchsorted(ends, np.maximum(end - 1, begin), side="right")
                a, z = np.minimum(a, len(ends) - 1), np.minimum(z, len(ends) - 1)
                who = a
                if rule == "last":
                    who = z
                elif rule == "most":
                    who = a.copy()
                    for t in np.flatnonzero(a != z):
                        inner = np.concatenate([[begin[t]], ends[a[t] : z[t]], [end[t]]])
                        who[t] += int(np.argmax(np.diff(inner)))
                where.append(np.full(len(ends), start + i))
                numbers.append(np.arange(len(ends)))
                froms.append(np.concatenate([[0], ends[:-1]]))
                tos.append(np.minimum(ends, len(text)))
                tokens.append(np.bincount(who, minlength=len(ends)))
                crossing.append(np.bincount(who[a != z], minlength=len(ends)))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (numbers, froms, tos, tokens, crossing)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(where))), *columns], ["_key", "section", "first_char", "after_char", "n_tokens", "n_crossing"])


def count_tokens(docs: DataFrame, key: str, text: str, ends: Column | None = None, rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """key, section (0, 1, ...), first_char, after_char, n_tokens and n_crossing of every section of every document.

    A document is encoded once and whole. ends: an ascending array of the character positions where its sections end,
    so that sections follow one another; the last one also has what comes after the last end. Without it, lines are the
    sections. The character spans of
    tokens, in order, are joined to those intervals by binary search, and rule says which section gets a token that
    crosses. The n_tokens of a document's sections add up to its number of tokens; n_crossing are those given by the rule.
    A token that is a part of one character has that character's span. Null texts are empty and have one section; so has
    a null or empty array. Keys may be null or repeated. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_file(TOKENIZER)
    schema = f"_key {docs.schema[key].dataType.simpleString()}, section long, first_char long, after_char long, n_tokens long, n_crossing long"
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), *([] if ends is None else [ends.alias("_ends")]))
    return rows.mapInArrow(lambda it: _attributed(it, path, rule), schema).withColumnRenamed("_key", key)


def op2(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
