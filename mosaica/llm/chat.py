"""Chat formatting as prefix trees.

Each conversation becomes a list of segments, one a turn: a header that names the role, the escaped text
and an end mark. Conversations that start with the same turns share these nodes of a tree, whose tokens
(here: code points of the segments) are emitted once, in depth-first order over the whole table. A token's
position id is its depth in its own conversation, and it may attend to its node's earlier tokens and to
the intervals of its ancestors.

How it is done in Spark: a node's key is the hash of the turns up to it. Conversations are ranked by their
lists of keys (a range sort, numbered across partitions); a node belongs to its first conversation in that
order, and (rank, depth) of all nodes is the depth-first order. Running sums over partitions give each
node's place in the emitted sequence. No tree, conversation group or shared turn is gathered in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.llm.common import ready, skew_join, stored

# Fixed values of the template: a turn is MARK + role + ROLE_END + text + END.
MARK, ROLE_END, END = "### ", ":\n", "</turn>\n"
#: Strings that a text or role must not hold as they are: each gets a backslash before it, as a backslash does.
CONTROL = ["\\", "###", "</turn>", ":\n"]

_escape = regex.compile("|".join(map(regex.escape, CONTROL)))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "(" + "|".join("\\Q" + c + "\\E" for c in CONTROL) + ")", r"\\$1")


def unescape(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text, flags=regex.DOTALL)


def segment(role: Column, text: Column) -> tuple[Column, Column]:
    """The header and the rest of a turn."""
    return F.concat(F.lit(MARK), escape(role), F.lit(ROLE_END)), F.concat(escape(text), F.lit(END))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; start and end are of the escaped text."""
    turns, at = [], 0
    mark = regex.compile(r"(?:[^\\]|\\.)*?(?=" + regex.escape(ROLE_END) + ")", regex.DOTALL)
    body = regex.compile(r"(?:[^\\]|\\.)*?(?=" + regex.escape(END) + ")", regex.DOTALL)
    while at < len(formatted):
        if not formatted.startswith(MARK, at):
            raise ValueError(f"no turn starts at {at}")
        role = mark.match(formatted, at + len(MARK))
        text = body.match(formatted, role.end() + len(ROLE_END))
        turns.append((unescape(role[0]), unescape(text[0]), text.start(), text.end()))
        at = text.end() + len(END)
    return turns


def running(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows, range-sorted by `order`, with `name`: the sum of `amount` over all rows before, across partitions.

    Each sorted partition is numbered by itself; what goes before it is the sum of the partitions before,
    of which there are few. The sort is written down first, so both passes see the same partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_amount", amount).repartitionByRange(n, *order)
    rows = stored(rows.withColumn("_pid", F.spark_partition_id()))
    sums = rows.groupBy("_pid").agg(F.sum("_amount").alias("_s"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sums.select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    return local.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_local")).drop("_pid", "_amount", "_local", "_start")


def prefix_tree(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the conversations of rows, in order of `turn` (ties: role, then a digest of the text).

    nodes: node long, depth int (0: first turn), role, header, body (escaped text and end mark), loss boolean (assistant turns),
    start, end long (tokens in the emitted sequence), position long (position id of its first token), attends
    array<struct<start, end>> (its ancestors' tokens; neighbours merged). members: conv_id, depth, node.

    Null roles and texts count as empty; equal conversations share all nodes; a null conv_id is a
    conversation of its own; repeated rows are turns of their own. An empty table gives no rows.
    """
    ready(rows.sparkSession)
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # turns are told apart by a digest, so that a conversation is gathered without its texts
    turns = stored(rows.withColumn("digest", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest"))).alias("t"))

    def chain(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                keys, h = [], b""
                for x in t:
                    h = hashlib.sha256(h + x["digest"].encode()).digest()
                    keys.append(int.from_bytes(h[:8], "big", signed=True))
                out.append(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "t", "path"])

    kind = convs.schema["t"].dataType.simpleString()
    ident = convs.schema["conv_id"].dataType.simpleString()
    convs = convs.mapInArrow(chain, f"conv_id {ident}, t {kind}, path array<long>")
    convs = running(convs, ["path", "conv_id"], F.lit(1).cast("long"), "rank")
    members = convs.select("conv_id", "rank", "t", F.posexplode("path").alias("depth", "node"))
    members = stored(members.select("conv_id", "rank", "depth", "node", F.element_at("t", F.col("depth") + 1)["digest"].alias("digest")))
    header, body = segment(F.col("role"), F.col("text"))
    texts = turns.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text")).select("digest", "role", header.alias("header"), body.alias("body"))
    owned = members.groupBy("node").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.min("digest").alias("digest"))
    owned = skew_join(owned, texts, ["digest"]).drop("digest")
    size = (F.char_length("header") + F.char_length("body")).cast("long")
    nodes = running(owned, ["rank", "depth"], size, "start").withColumn("end", F.col("start") + size)
    nodes = stored(nodes)
    # a node's ancestors are found along its own conversation
    own = skew_join(members.select("conv_id", "node", "depth", F.col("rank").alias("of")), nodes.select("node", "rank", "start", "end"), ["node"])
    path = own.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "rank", "start", "end"))).alias("p"))
    own_part = path.select(F.col("of"), F.filter("p", lambda x: x["rank"] < F.col("of")).alias("p"), F.filter("p", lambda x: x["rank"] == F.col("of")).alias("mine"))
    merged = F.aggregate(
        "p",
        F.expr("array() :: array<struct<start: bigint, end: bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), x["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    above = own_part.select(merged.alias("above"), "mine").select("above", F.aggregate("above", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("before"), F.explode("mine").alias("m"), F.col("mine")[0]["start"].alias("first"))
    # the ancestors that the conversation itself owns lie before the node without a gap
    mine = F.when(F.col("m.start") > F.col("first"), F.array(F.struct(F.col("first").alias("start"), F.col("m.start").alias("end")))).otherwise(F.expr("array() :: array<struct<start: bigint, end: bigint>>"))
    joined = F.when(
        (F.size("above") > 0) & (F.size(mine) > 0) & (F.element_at("above", -1)["end"] == F.col("first")),
        F.concat(F.slice("above", 1, F.size("above") - 1), F.array(F.struct(F.element_at("above", -1)["start"].alias("start"), F.col("m.start").alias("end")))),
    ).otherwise(F.concat("above", mine))
    attends = above.select(F.col("m.node").alias("node"), (F.col("before") + F.col("m.start") - F.col("first")).alias("position"), joined.alias("attends"))
    nodes = nodes.join(attends, "node").select("node", "depth", "role", "header", "body", (F.col("role") == "assistant").alias("loss"), "start", "end", "position", "attends")
    return nodes, members.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the emitted segments.

    The formatted turns of each conversation are read from its nodes in order and parsed; what the loss mask
    covers is taken from the parsed places, unescaped. Repeated turns count each time; an empty table gives no rows.
    """
    ident = members.schema["conv_id"].dataType.simpleString()
    parts = skew_join(members, nodes.select("node", "position", "header", "body", "loss"), ["node"]).select("conv_id", "depth", "position", "loss", "header", "body")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Reader:
        """What is known of a conversation whose turns come one after the other; none of them is kept."""

        def __init__(self, conv):
            self.conv, self.turns, self.whole, self.loss, self.masked, self.at = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def take(self, position: int, loss: bool, header: str, body: str) -> None:
            if position != self.at:
                raise ValueError("position ids have a gap")
            formatted = header + body
            for role, text, lo, hi in parse(formatted):
                self.turns += 1
                self.whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    masked = unescape(formatted[lo:hi])
                    self.masked += len(masked)
                    self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.at += len(formatted)

        def row(self) -> tuple:
            return self.conv, self.turns, self.whole.hexdigest(), self.masked, self.loss.hexdigest(), self.at

    def run(batches):
        reader = None
        for batch in batches:
            done = []
            for conv, _, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or reader.conv != conv:
                    done += [reader.row()] if reader else []
                    reader = Reader(conv)
                reader.take(*turn)
            if done:
                yield batch_of(done, batch.schema.field(0).type)
        if reader:
            yield batch_of([reader.row()], batch.schema.field(0).type)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # turns of a conversation pass through one task in order, a batch at a time
    return parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, f"conv_id {ident}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
