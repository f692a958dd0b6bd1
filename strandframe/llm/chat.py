"""Chat formatting over prefix trees.

Each turn becomes a segment: a head, the escaped text and a tail, tokenised by byte-level BPE one by one, so that
no token crosses from markup into text. Conversations with equal turns are one; those that share initial
turns share these segments. A pack holds the trees of some conversations; it emits each shared segment once,
depth first, and gives its tokens position ids (the place in the conversation), its loss span (an assistant's text),
and attention intervals: the spans of the ancestors, neighbouring ones joined. A conversation is read back from the
pack by the intervals of its last segment.

Escaping: backslash, ``[`` and ``<`` inside texts and role names are preceded by a backslash, so that no control
string can stand in a text; the template's own brackets have none before them.

Packs are bounded: first turns with more than ``PACK`` different conversations are spread over several packs by a
hash of the rest, and each of these packs emits the first turn once.

Defined results: a null text or role is empty; turns go by turn number (null first), role and text, so repeated
turns stand beside each other; a null conv_id is one conversation; one conversation is read as a whole, however
long; an empty table gives an empty one; other columns are not passed on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.bpe import encode, encoding
from strandframe.llm.common import checkpointed, partitions

PACK, HOT_MOST = 128, 100_000
#: Head and tail of a turn's text by role; other roles are named.
TEMPLATE = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
NODE = "array<struct<start:int,stop:int,position:int,loss_start:int,loss_stop:int,attends:array<struct<start:int,stop:int>>>>"
_ESCAPE = re.compile(r"([\\\[<])")
_PLAIN = re.compile(r"\\(.)", re.S)
_UNIT = r"(?:[^\\\[<]|\\.)*"
_TURN = re.compile(rf"<<SYS>>\n(?P<system>{_UNIT})\n<</SYS>>\n|\[INST\] (?P<user>{_UNIT}) \[/INST\]|\[ROLE\](?P<role>{_UNIT})\[TEXT\](?P<other>{_UNIT})\[/ROLE\]| (?P<assistant>{_UNIT})</s>", re.S)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def plain(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    head, tail = TEMPLATE.get(role) or (f"[ROLE]{escaped(role)}[TEXT]", "[/ROLE]")
    return head, escaped(text), tail


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; an error if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        kind = found.lastgroup
        out.append((plain(found["role"]), plain(found["other"])) if kind == "other" else (kind, plain(found[kind])))
        at = found.end()
    return out


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, content, first, turns): the turns of each conversation in order; content and first are keys of all turns and of the first."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    listed = listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return listed.select("conv_id", F.sha2(F.to_json("turns"), 256).alias("content"), F.xxhash64(F.get("turns", F.lit(0))).alias("first"), "turns")


def build_pack(pack: int, contents: list[str], conversations: list[list[tuple[str, str]]], enc) -> dict:  # noqa: ANN001
    """One pack: input_ids, position_ids, nodes (segments with spans and attention) and leaves (content and its last segment)."""
    ids: list[int] = []
    positions: list[int] = []
    nodes: list[dict] = []
    leaves: list[dict] = []
    order = sorted(range(len(contents)), key=lambda i: (conversations[i], contents[i]))  # so that a depth-first walk meets them in turn
    path: list[tuple[tuple[str, str], int]] = []
    for i in order:
        turns = conversations[i]
        shared = 0
        while shared < min(len(path), len(turns)) and path[shared][0] == turns[shared]:
            shared += 1
        del path[shared:]
        for turn in turns[shared:]:
            parent = nodes[path[-1][1]] if path else None
            position = parent["position"] + parent["stop"] - parent["start"] if parent else 0
            attends = [dict(x) for x in parent["attends"]] if parent else []
            if parent:
                if attends and attends[-1]["stop"] == parent["start"]:
                    attends[-1]["stop"] = parent["stop"]
                else:
                    attends.append({"start": parent["start"], "stop": parent["stop"]})
            head, text, tail = (encode(enc, x) for x in parts(*turn))
            start = len(ids)
            ids += [*head, *text, *tail]
            positions += range(position, position + len(ids) - start)
            loss = (start + len(head), start + len(head) + len(text)) if turn[0] == "assistant" else (start, start)
            nodes.append({"start": start, "stop": len(ids), "position": position, "loss_start": loss[0], "loss_stop": loss[1], "attends": attends})
            path.append((turn, len(nodes) - 1))
        leaves.append({"content": contents[i], "node": path[-1][1] if path else -1})
    return {"pack": pack, "input_ids": ids, "position_ids": positions, "nodes": nodes, "leaves": leaves}


def format_packs(listed: DataFrame, path: str, pattern: str) -> DataFrame:
    """The packs of the conversations that ``paths`` lists: pack, input_ids, position_ids, nodes, leaves."""
    # Only ids meet by content, which many conversations may have; turns meet by the ids that are chosen.
    chosen = listed.groupBy("content").agg(F.min(F.struct("conv_id")).alias("of")).select(F.col("of.conv_id").alias("of"))
    distinct = checkpointed(listed.join(chosen, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("content", "first", "turns"))
    n = distinct.count()
    counts = distinct.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PACK)
    # A hot first turn has over PACK conversations, so there are at most n / PACK of them; few enough are sent to all.
    counts = F.broadcast(counts) if n // PACK <= HOT_MOST else counts
    spread = F.when(F.col("n").isNull(), F.pmod(F.col("first"), F.lit(max(1, -(-n // PACK))))).otherwise(F.xxhash64("first", F.pmod(F.xxhash64("content"), F.ceil(F.col("n") / PACK))))
    packed = distinct.join(counts, "first", "left").select(spread.alias("pack"), "content", "turns")
    schema = f"pack long, input_ids array<int>, position_ids array<int>, nodes {NODE}, leaves array<struct<content:string,node:int>>"
    arrow = pa.schema([("pack", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("nodes", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("position", pa.int32()), ("loss_start", pa.int32()), ("loss_stop", pa.int32()), ("attends", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))), ("leaves", pa.list_(pa.struct([("content", pa.string()), ("node", pa.int32())])))])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["pack", "content", "turns"]).to_pylist()
        made = build_pack(rows[0]["pack"], [r["content"] for r in rows], [[(t["role"], t["text"]) for t in r["turns"]] for r in rows], encoding(path, pattern))
        return pa.Table.from_pylist([made], schema=arrow)

    return packed.groupBy("pack").applyInArrow(run, schema)


def read_back(packs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of each conversation in the packs, from the tokens that its last segment attends to: content, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "content string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(pack: dict, leaf: dict, enc) -> dict:  # noqa: ANN001
        ids, nodes = pack["input_ids"], pack["nodes"]
        last = nodes[leaf["node"]] if leaf["node"] >= 0 else None
        spans = [(x["start"], x["stop"]) for x in last["attends"]] + [(last["start"], last["stop"])] if last else []
        formatted = b"".join(enc.decode_bytes(ids[a:b]) for a, b in spans).decode()
        turns = turns_of(formatted)
        inside = [n for n in nodes if n["loss_stop"] > n["loss_start"] and any(a <= n["start"] and n["stop"] <= b for a, b in spans)] if len(nodes) < 64 else [nodes[k] for k in sorted({k for a, b in spans for k in _between(pack, a, b)}) if nodes[k]["loss_stop"] > nodes[k]["loss_start"]]
        loss = "".join(plain(enc.decode_bytes(ids[n["loss_start"] : n["loss_stop"]]).decode()) for n in inside)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        return {"content": leaf["content"], "n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(formatted)}

    def _between(pack: dict, a: int, b: int) -> range:
        import bisect

        starts = pack.setdefault("starts", [n["start"] for n in pack["nodes"]])
        return range(bisect.bisect_left(starts, a), bisect.bisect_left(starts, b))

    def run(batches):  # noqa: ANN001, ANN202
        enc = encoding(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.slice(i, 1).to_pylist()[0]
                made = [digest(pack, leaf, enc) for leaf in pack["leaves"]]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("content", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return packs.select("input_ids", "nodes", "leaves").mapInArrow(run, schema)


def formatted_digests(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digests of each conversation, read back from the packs. Contents that many conversations have are few, and are sent to these."""
    listed = checkpointed(paths(conversations))
    digests = checkpointed(read_back(format_packs(listed, path, pattern), path, pattern))
    members, often = listed.select("conv_id", "content"), 2 * partitions(conversations)
    hot = members.groupBy("content").count().filter(F.col("count") * often > listed.count()).select("content")
    hot = F.broadcast(checkpointed(digests.join(F.broadcast(hot), "content")))  # fewer than ``often`` rows
    rest = members.join(hot.select("content"), "content", "left_anti").join(digests, "content")
    return members.join(hot, "content").unionByName(rest).drop("content")


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '[', '\\['), '<', '\\<') AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
           ELSE 19 + length(replace(replace(replace(role, '\\', '\\\\'), '[', '\\['), '<', '\\<')) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("\\\\", "\\")
