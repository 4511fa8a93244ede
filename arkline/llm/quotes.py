"""Chat formatting by quotation linking.

A message's lines that begin with > marks are quotes; the number of marks is the level. A
quoted passage (neighbouring lines of one level) and each of its lines are normalised
(marks and surrounding blanks off, white space as one blank, case folded) and hashed, as
are every message's own body, paragraphs and lines. The hashes join within a conversation:
a passage's original is the earliest message that has it as its own, before the message
that quotes it. Of the lowest level that has an original, a message replies to the one of a
whole passage before one of a line, of a longer text before a shorter, then to the one that
most of its hashes lead to, then to the latest; without any it begins a thread. Messages come
out with a sortable reply order, without quotes and without the attribution line above them;
``conversations`` gathers them to one ordered row each.

Scale: hashes are aggregated to one original each before they join, so a line that every
message holds joins one row; only conversations with quotes take part. For the order the last
reply of a message continues its chain and every other reply begins one. Places in chains come
from doubling steps, and so do chains' own keys, which have a part for each chain on the way
from the thread's first message: a conversation in which each message answers the one before
has keys of a fixed length, and no task holds a conversation.

Defined results: a null text is an empty message; a null role is "user"; rows with a null
conversation or turn begin threads of their own; equal (conversation, turn) rows each come
out, and replies go to that turn; a message of nothing but quotes has empty content; texts
without quotes stay as they are; invalid UTF-8 reads as U+FFFD. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_ATTRIBUTION = re.compile(r"(?:on\b.*|.*\S )(?:wrote|writes|a écrit|escribió|schrieb)\b.*:\s*|-+ ?original message ?-+\s*", re.I | re.S)
TURN_DIGITS = 20
PLACE_DIGITS = 12
_ROLES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}


def normalised(text: str) -> str:
    return " ".join(text.split()).casefold()


def passage_hash(text: str) -> bytes | None:
    """None for a passage without anything but blanks."""
    text = normalised(text)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16] if text else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(the message without quotes, its quoted passages as (level, text))."""
    if ">" not in text:
        return text, []
    own, passages = [], []
    last_level = 0
    for line in text.split("\n"):
        m = _QUOTE.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last_level:
            passages[-1][1].append(m[2])
        else:
            if not last_level and own:  # what introduces the quotes
                while own and not own[-1].strip():
                    own.pop()
                if own and _ATTRIBUTION.fullmatch(own[-1]):
                    own.pop()
            passages.append((level, [m[2]]))
        last_level = level
    if not passages:
        return text, []
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return body, [(level, "\n".join(lines)) for level, lines in passages]


def units(body: str) -> set[bytes]:
    parts = [body, *re.split(r"\n\s*\n", body), *body.split("\n")]
    return {h for h in map(passage_hash, parts) if h is not None}


_PARSED = "content string, _ark_quotes array<struct<level: int, whole: int, size: int, hash: binary>>, _ark_units array<binary>, n_quotes int"


def _parsed(messages: DataFrame, text_col: str, with_units: bool) -> DataFrame:
    added = T.StructType.fromDDL(_PARSED)
    kept = [c for c in messages.columns if c not in added.names]
    source = messages.select(*[messages[c] for c in kept], messages[text_col].cast("binary").alias("_ark_text"))
    schema = T.StructType([*source.schema.fields[:-1], *added.fields])

    def run(batches):
        for batch in batches:
            content, quotes, own, count = [], [], [], []
            for raw in batch.column(batch.num_columns - 1):
                body, passages = parse((raw.as_py() or b"").decode("utf-8", "replace"))
                hashes: dict = {}
                for level, passage in passages:
                    for part in (passage, *passage.split("\n")):
                        if (h := passage_hash(part)) is not None:
                            found = (int(part == passage), len(normalised(part)))
                            hashes[level, h] = max(found, hashes.get((level, h), found))
                content.append(body)
                quotes.append([{"level": a, "whole": w, "size": n, "hash": h} for (a, h), (w, n) in sorted(hashes.items())])
                own.append(sorted(units(body)) if with_units else [])
                count.append(len(passages))
            arrays = [pa.array(content, pa.string()), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("whole", pa.int32()), ("size", pa.int32()), ("hash", pa.binary())]))), pa.array(own, pa.list_(pa.binary())), pa.array(count, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return source.mapInArrow(run, schema)


def _role(c):
    low = F.lower(F.trim(c.cast("string")))
    known = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), low, F.lit("user"))


def link(messages: DataFrame, space: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """messages with role, content, n_quotes, n_linked (passage hashes with an original),
    reply_to (a turn, or null), depth and reply_order; sort by conversation and reply_order."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    plain = messages.select("*", _role(F.col(role_col)).alias("_ark_role")).drop("reply_to", "depth", "reply_order", "n_linked")
    quoting = space.table(
        _parsed(messages.select(conv_col, turn_col, text_col).where(F.coalesce(F.contains(F.col(text_col), F.lit(">")), F.lit(False))), text_col, False)
        .where(conv.isNotNull() & turn.isNotNull() & (F.col("n_quotes") > 0))
        .select(conv.alias("_q_conv"), turn.alias("_q_turn"), F.explode("_ark_quotes").alias("q"))
        .select("_q_conv", "_q_turn", F.col("q.level").alias("_q_level"), F.col("q.whole").alias("_q_whole"), F.col("q.size").alias("_q_size"), F.col("q.hash").alias("_q_hash"))
    )
    wanted = quoting.select("_q_conv").distinct()
    originals = _parsed(messages.join(wanted, conv == F.col("_q_conv"), "left_semi").select(conv_col, turn_col, text_col), text_col, True)
    originals = originals.where(turn.isNotNull()).select(conv.alias("_o_conv"), turn.alias("_o_turn"), F.explode("_ark_units").alias("_o_hash")).groupBy("_o_conv", "_o_hash").agg(F.min("_o_turn").alias("_o_turn"))
    met = quoting.join(originals, (F.col("_q_conv") == F.col("_o_conv")) & (F.col("_q_hash") == F.col("_o_hash")) & (F.col("_o_turn") < F.col("_q_turn")))
    less = lambda c: -F.col(c)
    each = met.groupBy("_q_conv", "_q_turn", "_q_level", "_o_turn").agg(F.max(F.struct("_q_whole", "_q_size")).alias("m"), F.count("*").alias("c"))
    best = F.min(F.struct("_q_level", (-F.col("m._q_whole")).alias("w"), (-F.col("m._q_size")).alias("s"), less("c").alias("c"), less("_o_turn").alias("t"))).alias("best")
    linked = met.groupBy(F.col("_q_conv").alias("_l_conv"), F.col("_q_turn").alias("_l_turn")).agg(F.count_distinct("_q_hash").alias("_q_linked"))
    chosen = each.groupBy("_q_conv", "_q_turn").agg(best).select("_q_conv", "_q_turn", (-F.col("best.t")).alias("_q_parent"))
    replies = space.table(chosen.join(linked, (F.col("_q_conv") == F.col("_l_conv")) & (F.col("_q_turn") == F.col("_l_turn"))).drop("_l_conv", "_l_turn"))
    paths = _paths(replies, space)
    out = _parsed(plain, text_col, False).join(paths, (conv == F.col("_p_conv")) & (turn == F.col("_p_turn")), "left")
    padded = _padded(turn)
    names = [c for c in messages.columns if c not in ("content", "role", "n_quotes", "n_linked", "reply_to", "depth", "reply_order", text_col, role_col)]
    return out.select(*names, F.col("_ark_role").alias("role"), "content", "n_quotes", F.coalesce("_p_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("_p_parent").alias("reply_to"), F.coalesce("_p_depth", F.lit(0)).alias("depth"), F.coalesce("_p_path", padded, F.lit("")).alias("reply_order"))


def _padded(c):
    """A turn as text that sorts like the number, negative ones first."""
    digits = F.lpad(F.abs(c.cast("decimal(20,0)")).cast("string"), TURN_DIGITS, "0")
    return F.when(c >= 0, digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210")))


def _paths(replies: DataFrame, space: Workspace) -> DataFrame:
    """_p_conv, _p_turn, _p_parent, _p_linked, _p_depth and _p_path of every message that replies or is replied to."""
    last = replies.groupBy("_q_conv", F.col("_q_parent").alias("_up")).agg(F.max("_q_turn").alias("_q_turn"))
    # a message's step up its chain; heads of chains are a reply that isn't the last, or begin a thread
    known = last.select(F.col("_q_conv").alias("_c"), F.col("_q_turn").alias("_m"), F.col("_up").alias("_top"), F.lit(1).cast("long").alias("_steps"))
    while True:
        known = space.table(known)
        above = known.select(F.col("_c").alias("_a_c"), F.col("_m").alias("_a_m"), F.col("_top").alias("_a_top"), F.col("_steps").alias("_a_steps"))
        joined = known.join(above, (F.col("_c") == F.col("_a_c")) & (F.col("_top") == F.col("_a_m")), "left")
        if joined.where("_a_m IS NOT NULL").isEmpty():
            break
        known = joined.select("_c", "_m", F.coalesce("_a_top", "_top").alias("_top"), (F.col("_steps") + F.coalesce("_a_steps", F.lit(0))).alias("_steps"))
    # all messages of threads with a reply, with the head of their chain and their place in it
    every = replies.select("_q_conv", "_q_turn").union(replies.select("_q_conv", "_q_parent")).distinct()
    placed = every.join(known, (F.col("_q_conv") == F.col("_c")) & (F.col("_q_turn") == F.col("_m")), "left")
    placed = space.table(placed.select("_q_conv", "_q_turn", F.coalesce("_top", "_q_turn").alias("_head"), F.coalesce("_steps", F.lit(0)).alias("_at")))
    # a chain's key: its head's turn, after the key and place of the message that it answers
    heads = placed.where("_at = 0").select(F.col("_q_conv").alias("_k_conv"), F.col("_q_turn").alias("_k_head"))
    up = replies.select(F.col("_q_conv").alias("_r_conv"), F.col("_q_turn").alias("_r_turn"), F.col("_q_parent").alias("_r_parent"))
    at = placed.select(F.col("_q_conv").alias("_v_conv"), F.col("_q_turn").alias("_v_turn"), F.col("_head").alias("_v_head"), F.col("_at").alias("_v_at"))
    chains = heads.join(up, (F.col("_k_conv") == F.col("_r_conv")) & (F.col("_k_head") == F.col("_r_turn")), "left").join(at, (F.col("_r_conv") == F.col("_v_conv")) & (F.col("_r_parent") == F.col("_v_turn")), "left")
    place = lambda c: F.lpad(c.cast("string"), PLACE_DIGITS, "0")
    keys = chains.select("_k_conv", "_k_head", F.col("_v_head").alias("_k_up"), F.coalesce(F.col("_v_at") + 1, F.lit(0)).alias("_k_depth"), F.when(F.col("_v_head").isNull(), _padded(F.col("_k_head"))).otherwise(F.concat_ws("/", place(F.col("_v_at")), _padded(F.col("_k_head")))).alias("_k_key"))
    while True:
        keys = space.table(keys)
        if keys.where("_k_up IS NOT NULL").isEmpty():
            break
        above = keys.select(F.col("_k_conv").alias("_a_conv"), F.col("_k_head").alias("_a_head"), F.col("_k_up").alias("_a_up"), F.col("_k_depth").alias("_a_depth"), F.col("_k_key").alias("_a_key"))
        joined = keys.join(above, (F.col("_k_conv") == F.col("_a_conv")) & (F.col("_k_up") == F.col("_a_head")), "left")
        keys = joined.select("_k_conv", "_k_head", F.col("_a_up").alias("_k_up"), (F.col("_k_depth") + F.coalesce("_a_depth", F.lit(0))).alias("_k_depth"), F.concat_ws("/", "_a_key", "_k_key").alias("_k_key"))
    out = placed.join(keys, (F.col("_q_conv") == F.col("_k_conv")) & (F.col("_head") == F.col("_k_head"))).select(F.col("_q_conv").alias("_p_conv"), F.col("_q_turn").alias("_p_turn"), (F.col("_k_depth") + F.col("_at")).cast("int").alias("_p_depth"), F.concat_ws("/", "_k_key", place(F.col("_at"))).alias("_p_path"))
    own = replies.select(F.col("_q_conv").alias("_r_conv"), F.col("_q_turn").alias("_r_turn"), F.col("_q_parent").alias("_p_parent"), F.col("_q_linked").alias("_p_linked"))
    return space.table(out.join(own, (F.col("_p_conv") == F.col("_r_conv")) & (F.col("_p_turn") == F.col("_r_turn")), "left").drop("_r_conv", "_r_turn"))


def conversations(linked: DataFrame, conv_col: str = "conv_id", most: int = 10_000) -> DataFrame:
    """conv_col, part and messages (role, content) in reply order, a row for each conversation. One
    of more than ``most`` messages, or one that two tasks share, continues in further rows; part,
    the reply order of a row's first message, orders them. Nulls are one conversation."""
    kind = linked.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, kind), *T.StructType.fromDDL("part string, messages array<struct<role: string, content: string>>").fields])
    rows = linked.select(F.col(conv_col).alias("_c"), F.col("reply_order").alias("_o"), "role", "content")
    rows = rows.repartitionByRange("_c", "_o").sortWithinPartitions("_c", "_o", "role", "content")

    def run(batches):
        conv, part, held, size = None, None, [], 0
        messages = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))

        def row(c):
            return pa.RecordBatch.from_arrays([pa.array([conv], c.type), pa.array([part], pa.string()), pa.array([held], messages)], names=schema.names)

        column = None
        for batch in batches:
            column = batch["_c"]
            for c, o, role, content in zip(*(batch[x].to_pylist() for x in ("_c", "_o", "role", "content")), strict=True):
                if held and (c != conv or len(held) >= most or size > 1 << 24):
                    yield row(column)
                    held, size = [], 0
                if not held:
                    conv, part = c, o
                held.append({"role": role, "content": content})
                size += len(content or "")
        if held:
            yield row(column)

    return rows.mapInArrow(run, schema)


def op8(spark, sf_dir):
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return link(messages, Workspace(spark, "quotes"))
