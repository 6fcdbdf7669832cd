"""Chat formatting: root-to-leaf paths of reply trees as conversations."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import kept

#: Marks of a turn, fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:[^<]|<(?!\|))*)<\|im_end\|>\n")


def escape(text: str) -> str:
    """No mark can stand in the result: each `<`, backslashes, `|` gets one more backslash."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text) if "<" in text else text


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask in code points)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the ancestors 1, 2, 4, ... replies above, by self-joins, and the way to the root of every message.

    A table has (tree, node, up) of the messages that are deep enough; only these are joined again, so that a few deep
    trees don't make the others take part in their rounds. The second result has (tree, node, steps, mass): messages on
    the way to the root and the sum of their scores. Messages on or below a cycle never reach a root and are left out.
    """
    present = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(present, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("mass"))
    state = kept(first, "pointers")
    done, open_, levels = [state.filter("up is null")], state.filter("up is not null"), []
    most = None
    while True:
        left = open_.count()
        if not left:
            break
        levels.append(open_.select("tree", "node", "up"))
        most = most or open_.groupBy("tree").count().agg(F.max("count")).first()[0]
        if 1 << (len(levels) - 1) > most:
            break  # only cycles are left
        ended = done[0]
        for part in done[1:]:
            ended = ended.unionByName(part)
        above = ended.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("mass").alias("rest"))
        far = open_.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("mass") + F.col("rest")).alias("mass"))
        state = kept(far, "pointers")
        done.append(state.filter("up is null"))
        open_ = state.filter("up is not null")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return levels, whole.select("tree", "node", "steps", "mass")


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, back) of the messages of every chosen branch; back counts from the leaf.

    ``nodes`` has tree, node, parent, score. A message whose parent is null or absent is a root. Branches are ranked in
    their tree by mean score, ties by the smaller leaf; ``top`` of them are chosen, or all.
    """
    levels, ways = pointers(nodes)
    if levels:
        ways = ways.join(levels[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    leaves = ways.select("tree", F.col("node").alias("leaf"), (F.col("mass") / F.col("steps")).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    leaves = leaves if top is None else leaves.filter(F.col("rank") <= top)
    paths = leaves.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k, step in enumerate(levels):
        above = paths.join(step, ["tree", "node"]).select("tree", "leaf", "score", "rank", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = kept(paths.select(above.columns).unionByName(above), "paths")
    return paths


SCHEMA = "branch_rank int, branch_score double, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_trees(messages: DataFrame, top: int | None = 1, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, learn: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen root-to-leaf path of each reply tree.

    Returns tree, branch_rank, branch_score, n_turns, formatted (the template's text) and loss_spans (code points of
    ``formatted`` that are learnt: the texts of role ``learn``). Marks within texts are escaped reversibly.

    Only ids are joined with themselves, log2 of the depth times; texts are joined to the paths once, dealt by path and
    formatted one conversation at a time. Null texts and roles are empty; null scores are 0; a null tree is a tree;
    messages with a null node are left out; of messages with equal tree and node the smallest (parent, role, text)
    stays; messages on or below a cycle of replies belong to no path (``left_out`` lists all these); other columns are ignored.
    """
    kind = dict(messages.select(tree).dtypes)[tree]
    value = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null"))
    rows = messages.filter(F.col(node).isNotNull()).select(key.alias("tree"), F.col(node).alias("node"), F.struct(F.col(parent).alias("parent"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), value.alias("score"), F.col(tree).alias("own")).alias("m"))
    rows = kept(rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), "messages")
    paths = branches(rows.select("tree", "node", "parent", "score"), top)
    turns = paths.select("tree", "node", "leaf", F.col("rank"), F.col("score").alias("branch_score"), "back").join(rows.select("tree", "node", "role", "text", "own"), ["tree", "node"])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        state, own_type = {"key": None, "turns": [], "head": None}, None
        done: list[tuple] = []

        def close():
            if state["key"] is not None:
                formatted, spans = format_turns(state["turns"], learn)
                done.append((*state["head"], len(state["turns"]), formatted, [{"start": a, "end": b} for a, b in spans]))

        def flush():
            columns = list(zip(*done)) if done else [[]] * 6
            types = [own_type, pa.int32(), pa.float64(), pa.int64(), pa.string(), spans_type]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[tree, "branch_rank", "branch_score", "n_turns", "formatted", "loss_spans"])
            done.clear()
            return out

        for batch in batches:
            own_type = batch.schema.field(2).type
            for t, r, own, s, who, said in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (t, r) != state["key"]:
                    close()
                    state.update(key=(t, r), turns=[], head=(own, r, s))
                state["turns"].append((who, said))
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    dealt = turns.repartition("tree", "rank").sortWithinPartitions("tree", "rank", F.desc("back"))
    return dealt.select("tree", "rank", "own", "branch_score", "role", "text").mapInArrow(run, f"`{tree}` {kind}, {SCHEMA}")


def left_out(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(tree, node, reason, n): the messages that ``format_trees`` leaves out, and how many rows they are: `no node`,
    `repeated` (all but one of equal tree and node), and `cycle` (on or below a cycle of replies)."""
    kind = dict(messages.select(node).dtypes)[node]
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null"))
    rows = messages.select(key.alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(tree).alias("own"))
    named = rows.filter("node is not null").groupBy("tree", "node").agg(F.min("own").alias("own"), F.min("parent").alias("parent"), F.count("*").alias("rows"))
    named = kept(named, "named")
    _, ways = pointers(named.select("tree", "node", "parent", F.lit(0.0).alias("score")))
    lost = named.join(ways.select("tree", "node"), ["tree", "node"], "left_anti").select("own", "node", F.lit("cycle").alias("reason"), F.lit(1).cast("long").alias("n"))
    repeated = named.filter("rows > 1").select("own", "node", F.lit("repeated").alias("reason"), (F.col("rows") - 1).alias("n"))
    without = rows.filter("node is null").groupBy("own").agg(F.count("*").alias("n")).select("own", F.lit(None).cast(kind).alias("node"), F.lit("no node").alias("reason"), "n")
    return lost.unionByName(repeated).unionByName(without).withColumnRenamed("own", tree).withColumnRenamed("node", node)


def linear(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: every turn replies to the one before. Ties of a turn go by role, then text."""
    order = Window.partitionBy(conversation).orderBy(turn, role, text)
    place = F.row_number().over(order).cast("long")
    return turns.select(F.col(conversation).alias("tree_id"), place.alias("node_id"), role, text).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, tree: str = "tree_id") -> DataFrame:
    """Digests of what a reader of ``formatted`` and ``loss_spans`` gets."""
    kind = dict(formatted.select(tree).dtypes)[tree]

    def run(batches):
        for batch in batches:
            rows = []
            for whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(whole)
                learnt = "".join(unescape(whole[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[tree, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(tree, "formatted", "loss_spans").mapInArrow(run, f"`{tree}` {kind}, {DIGESTS}")
