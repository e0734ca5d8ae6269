"""Operator 1: chat formatting over a prefix tree.

Conversations that share their first turns share a path of a tree: a node is a turn
with all turns before it, named by a hash chained over roles and texts. Each node's
text is emitted once, in depth-first order (of siblings, by hash): paths are ranked by
their chains of hashes, and a node comes where the first path that holds it does, by
depth. With its offset in that stream a node has its first position id (the length of
its ancestors) and the intervals of the stream that it may attend to before itself:
its ancestors, joined where they lie side by side. A conversation is read back by
cutting the stream, kept in pages of ``PAGE`` code points with their loss mask, at the
intervals of its last node.

Template: ``<s>[INST] text [/INST]`` for user, ``[SYS] text [/SYS]`` for system and
`` text</s>`` for assistant turns, ``[ROLE role] text [/ROLE]`` for any other role.
Inside texts and roles a backslash doubles and every ``[``, ``]``, ``<`` or ``>`` of a
control string is led by one, so markers never occur in escaped text and unescaping
gives every text back. The loss mask covers the escaped assistant texts.

Tokens, offsets and position ids count code points. Turns are ordered by turn (nulls
first), then role, then text; repeated rows are turns of their own. Null roles and texts
count as empty. Rows of null conv_id are one conversation. An empty table gives empty
results. One conversation is held by one task; rows are as many as turns, however long a
conversation is. Copies of conversations are one path from the first shuffle on, and keys
that a thousandth of a side's rows share (a common first turn) are met by a broadcast of
those keys alone, ``HOT`` at most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.prefix import prefix_sums

#: Before and after a turn's text, by role; "" stands for any other role. Fixed values.
MARKERS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>"), "": ("[ROLE {role}] ", " [/ROLE]")}
_CONTROL = re.compile(r"\\|[\[\]<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARKED = re.compile(r"<s>\[INST\] (?P<user>(?:[^\\\[\]<>]|\\.)*) \[/INST\]|\[SYS\] (?P<system>(?:[^\\\[\]<>]|\\.)*) \[/SYS\]|\[ROLE (?P<role>(?:[^\\\[\]<>]|\\.)*)\] (?P<other>(?:[^\\\[\]<>]|\\.)*) \[/ROLE\]| (?P<assistant>(?:[^\\\[\]<>]|\\.)*)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text in the template and the range of it under the loss mask."""
    before, after = MARKERS.get(role) or MARKERS[""]
    before, own = before.replace("{role}", escape(role)), escape(text)
    loss = len(own) if role == "assistant" else 0
    return before + own + after, len(before), len(before) + loss


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _MARKED.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        for role in ("user", "system", "assistant"):
            if m[role] is not None:
                out.append((role, unescape(m[role])))
        if m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["other"])))
    return out


PAGE, HOT = 4096, 1000
_TURNS = "conv_id bigint, leaf string, path string, idx bigint, node string, parent string, role string, body string, size bigint, loss_lo bigint, loss_hi bigint, position bigint"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "array<struct<lo:bigint,hi:bigint>>": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))}


def _named(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of equal key that follow one another."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as turns: node, its parent and the path's last node (leaf), body and position; path on last turns only."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "conv_id"):
            out, node, position, path, state = [], None, 0, [], b""
            for idx, row in enumerate(rows):
                role, text = row["role"] or "", row["text"] or ""
                state = hashlib.sha256(state + hashlib.sha256(role.encode()).digest() + hashlib.sha256(text.encode()).digest()).digest()
                parent, node = node, state[:16].hex()
                path.append(node[:16])
                body, lo, hi = formatted(role, text)
                out.append((idx, node, parent, role, body, len(body), lo, hi, position))
                position += len(body)
            last = len(out) - 1
            for i in range(0, len(out), 1000):
                yield _named(_TURNS, [(row["conv_id"], node, "".join(path) if x[0] == last else None, *x) for x in out[i : i + 1000]])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return plain.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(chain, _TURNS)


def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (written) joined with right (one small row a key): by broadcast for keys that a HOT-th of left or more share, else by shuffle."""
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") * HOT >= left.count()).select(key)  # HOT rows at most
    found = right.join(F.broadcast(hot), key, "left_semi")
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return left.join(F.broadcast(found), key).unionByName(rest)


_ATTENDS = "node string, attends array<struct<lo:bigint,hi:bigint>>"


def _attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals before each node, for paths that own the node."""
    for path in _runs(batches, "leaf"):
        out, held = [], []
        for x in path:
            if x["own"]:
                out.append((x["node"], [{"lo": lo, "hi": hi} for lo, hi in held]))
            if held and held[-1][1] == x["offset"]:
                held[-1] = (held[-1][0], x["offset"] + x["size"])
            else:
                held.append((x["offset"], x["offset"] + x["size"]))
        if out:
            yield _named(_ATTENDS, out)


def prefix_tree(said: DataFrame) -> DataFrame:
    """The tree of turns() (written): one row a node, in depth-first order of ``offset``.

    Columns: node, parent, role, body, size, loss_lo, loss_hi, offset (in the stream),
    position_start (its first position id; position ids count on from there), and
    attends: the stream's intervals that its ancestors fill, outermost first.
    """
    paths = said.filter("path is not null").groupBy("leaf").agg(F.min("path").alias("path")).withColumn("_one", F.lit(1))
    ranks = materialize(prefix_sums(paths, [F.col("path"), F.col("leaf")], "_one", "chat-paths").select("leaf", F.col("_rank").alias("rank")), "chat-ranks")
    # Copies of a path are one from here on; a shared turn is pre-aggregated where it is read.
    chains = materialize(said.select("leaf", "idx", "node").distinct().join(ranks, "leaf"), "chat-chains")
    first = chains.groupBy("node").agg(F.min("rank").alias("rank"))
    body = said.groupBy("node").agg(*(F.first(c).alias(c) for c in ("idx", "parent", "role", "body", "size", "loss_lo", "loss_hi", "position")))
    placed = prefix_sums(body.join(first, "node"), [F.col("rank"), F.col("idx")], "size", "chat-nodes").withColumnRenamed("_start", "offset").drop("_rank", "_total")
    stream = materialize(placed, "chat-stream")
    located = meet(chains.withColumnRenamed("rank", "of"), stream.select("node", "offset", "size", "rank"), "node").withColumn("own", F.col("rank") == F.col("of"))
    ordered = located.select("leaf", "idx", "node", "offset", "size", "own").repartition("leaf").sortWithinPartitions("leaf", "idx")
    attends = ordered.mapInArrow(_attended, _ATTENDS)
    return stream.join(attends, "node").select("node", "parent", "role", "body", "size", "loss_lo", "loss_hi", "offset", F.col("position").alias("position_start"), "attends")


_PAGES = "page bigint, start bigint, text string, mask string"


def stream_pages(tree: DataFrame) -> DataFrame:
    """The stream as pages of PAGE code points: page, text, mask (a digit for each code point, 1 under the loss mask)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                body, offset = x["body"], x["offset"]
                mask = "0" * x["loss_lo"] + "1" * (x["loss_hi"] - x["loss_lo"]) + "0" * (len(body) - x["loss_hi"])
                at = 0
                while at < len(body):
                    page = (offset + at) // PAGE
                    end = min(len(body), (page + 1) * PAGE - offset)
                    out.append((page, offset + at, body[at:end], mask[at:end]))
                    at = end
            yield _named(_PAGES, out)

    parts = tree.select("offset", "body", "loss_lo", "loss_hi").mapInArrow(cut, _PAGES)
    listed = parts.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("start", "text", "mask"))).alias("x"))  # PAGE of them at most
    return listed.select("page", *(F.array_join(f"x.{c}", "").alias(c) for c in ("text", "mask")))


_READ = "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, leaf_start bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pieces in _runs(batches, "leaf"):
        text, mask = "".join(x["text"] for x in pieces), "".join(x["mask"] for x in pieces)
        said = parse(text)
        learnt = "".join(unescape(text[run.start() : run.end()]) for run in re.finditer("1+", mask))
        turns_hash = hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in said).encode()).hexdigest()
        yield _named(_READ, [(pieces[0]["leaf"], len(said), turns_hash, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), pieces[0]["leaf_start"])])


def read_back(said: DataFrame, tree: DataFrame) -> DataFrame:
    """What the stream says of each conversation, cut at the intervals that its last node attends to and its own: its turns, parsed
    and unescaped, all text under the loss mask, and the last turn's first position id (leaf_start)."""
    convs = said.filter("path is not null").select("conv_id", "leaf")
    pages = materialize(stream_pages(tree), "chat-pages")
    own = F.array(F.struct(F.col("offset").alias("lo"), (F.col("offset") + F.col("size")).alias("hi")))
    leaves = tree.withColumnRenamed("node", "leaf").join(convs.select("leaf").distinct(), "leaf")
    spans = leaves.select("leaf", F.col("position_start").alias("leaf_start"), F.posexplode(F.concat("attends", own)).alias("nth", "span"))
    asked = spans.select("leaf", "leaf_start", "nth", "span.*", F.explode(F.expr(f"sequence(span.lo div {PAGE}, (span.hi - 1) div {PAGE})")).alias("page"))
    met = meet(materialize(asked, "chat-asked"), pages, "page")
    begin, end = F.greatest("lo", F.col("page") * PAGE), F.least("hi", (F.col("page") + 1) * PAGE)
    cut = [F.substring(c, begin - F.col("page") * PAGE + 1, end - begin).alias(c) for c in ("text", "mask")]
    ordered = met.select("leaf", "leaf_start", "nth", "page", *cut).repartition("leaf").sortWithinPartitions("leaf", "nth", "page")
    digests = materialize(ordered.select("leaf", "leaf_start", "text", "mask").mapInArrow(_digest, _READ), "chat-digests")
    return meet(convs, digests, "leaf").drop("leaf")


def format_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all conversations (conv_id and path on last turns) and the prefix tree with their text, both written."""
    said = materialize(turns(conversations), "chat-turns")
    return said, materialize(prefix_tree(said), "chat-tree")
