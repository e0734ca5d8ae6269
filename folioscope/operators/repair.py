"""Checks of texts against words and sources, graph repair, passages topped up (T23, T27, G13, the top-up of L2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.catalogue import coverage
from folioscope.operators.graph import merged_descriptions

_ANCHOR = 60


def word_validity(texts: DataFrame, key: str, text: str, words: DataFrame, least: int = 40) -> DataFrame:
    """key, n_words, validity: the share of a text's words (three letters and more, broken ones joined) that ``words`` (word) holds; -1 under ``least`` words."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"-\s+", ""), F.lit("([a-z]{3,})"), 1)
    each = texts.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    known = each.join(words.select("word").distinct().withColumn("_known", F.lit(1)), "word", "left")
    sums = known.groupBy(key).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.coalesce("_known", F.lit(0))).alias("_valid"))
    n = F.coalesce("n_words", F.lit(0))
    return texts.select(key).join(sums, key, "left").select(key, n.alias("n_words"), F.when(n < least, -1.0).otherwise(F.round(F.col("_valid") / n, 3)).alias("validity"))


def _flat(text: str) -> tuple[str, list[int]]:
    """text in small letters with single spaces, and where each of its characters was."""
    if text.isascii():  # letters keep their number, so whole runs move at once
        starts, end = [], 0
        for m in re.finditer(r"\s{2,}", text):
            starts.extend(range(end, m.start() + 1))
            end = m.end()
        starts.extend(range(end, len(text)))
        return re.sub(r"\s+", " ", text).lower(), starts
    starts = [m.start() for m in re.finditer(r"\s+|\S", text)]
    return "".join(" " if text[i].isspace() else text[i].lower()[0] for i in starts), starts


def span_of(flat: str, starts: list[int], piece: str) -> tuple[int, int] | None:
    """Where a piece lies in the text that _flat() was given, whatever their spaces and capitals: as a whole, else from its first 60 characters to its last."""
    wanted = _flat(piece)[0].strip()
    if not wanted:
        return None
    first = flat.find(wanted)
    last = first + len(wanted)
    if first < 0:
        head, tail = flat.find(wanted[:_ANCHOR]), flat.rfind(wanted[-_ANCHOR:])
        if head < 0 or tail < 0:
            return None
        first, last = head, tail + len(wanted[-_ANCHOR:])
    return (starts[first], starts[last - 1] + 1) if last > first else None


#: Texts that a task holds as Python objects at once.
_HELD = 64


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, piece_id, s, e of rows (doc_id, ids, pieces, text), a few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), _HELD):
            few = batch.slice(at, _HELD)
            found = []
            for pieces, text in zip(few.column("pieces").to_pylist(), few.column("text").to_pylist()):
                flat = _flat(text or "")
                found += [span_of(*flat, p or "") or (None, None) for p in pieces]
            ids = few.column("ids")
            docs = few.column("doc_id").take(pc.list_parent_indices(ids))
            ends = (pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([docs, ids.flatten(), *ends], ["doc_id", "piece_id", "s", "e"])


def located(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, piece_id, s, e: the span of each piece (doc_id, piece_id, piece) in its text (doc_id, text); null where it is not found. A text moves once, whatever its pieces."""
    listed = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_id", "piece"))).alias("p"))
    met = listed.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.col("p.piece_id").alias("ids"), F.col("p.piece").alias("pieces"), "text")
    kinds = (pieces.schema[c].dataType.simpleString() for c in ("doc_id", "piece_id"))
    return met.mapInArrow(_spans, "doc_id {}, piece_id {}, s int, e int".format(*kinds))


def repaired(held: DataFrame, fragments: DataFrame) -> DataFrame:
    """Entities' merged descriptions after the documents that the graph holds no chunk of are merged anew.

    held, fragments: name, description, doc, chunk; documents held in part are left as they are.
    """
    state = coverage(fragments.select("doc", "chunk").distinct(), held, "doc", "chunk")
    lost = fragments.join(state.filter("state = 'none'"), "doc", "left_semi")
    return merged_descriptions(held.unionByName(lost))


def topped_up(picked: DataFrame, chunks: DataFrame, group: str, order: str, tokens: str, least: int = 6000) -> DataFrame:
    """picked, and if it has fewer than ``least`` tokens, chunks from the front of each group until it has; a chunk has a token or more, so ``least`` rows are looked at."""
    spent = picked.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("_spent"))
    rest = chunks.join(picked.select(group, order), [group, order], "left_anti").filter(F.col(tokens) > 0).orderBy(group, order).limit(least)
    before = F.coalesce(F.sum(tokens).over(Window.orderBy(group, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = rest.withColumn("_before", before).crossJoin(F.broadcast(spent)).filter(F.col("_before") + F.col("_spent") < least)
    return picked.select(group, order, tokens).unionByName(added.select(group, order, tokens))
