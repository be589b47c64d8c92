"""Chat formatting by token-level assembly.

A turn is ``<|turn|> role <|header|> text <|end|>``. Role and text are encoded as separate segments and
the three marks are spliced in as reserved ids above the vocabulary, so no text can spell a mark in
ids. In the rendered string too no text can: control strings inside a text are escaped reversibly.
The loss mask comes from the prefix sums of the segments' lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, map_batches, ship_file, table, texts

#: Marks of the template, in the order of their reserved ids (from the vocabulary's end on).
MARKS = ("<|turn|>", "<|header|>", "<|end|>")
#: Strings that must not survive inside a text.
CONTROL = (*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
CHARS_AT_ONCE = 4_000_000

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\([\\.])")


def escape(text: str) -> str:
    r"""Doubles each backslash and breaks each control string by ``\.`` after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


class Codec:
    """Segments to ids and back, over a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.first = self.inner.get_vocab_size(with_added_tokens=True)

    def segments(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.inner.encode_batch(parts, add_special_tokens=False)]

    def assemble(self, roles: list[str], contents: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        ids = self.segments([escape(x) for pair in zip(roles, contents) for x in pair])
        turn, header, end = range(self.first, self.first + 3)
        for k, role in enumerate(roles):
            parts = [[turn], ids[2 * k], [header], ids[2 * k + 1], [end]]
            bounds = np.cumsum([0, *map(len, parts)])
            flat = np.fromiter((i for part in parts for i in part), np.int32, bounds[-1])
            at = np.arange(bounds[-1])
            yield flat, (at >= bounds[3]) & (at < bounds[4]) & (role == TRAINED_ROLE)

    def read(self, ids: list[int], mask: list[bool]) -> tuple[str, str, str, int]:
        """Role, text, text under the loss mask, and length of the rendered string, from ids and mask alone."""
        turn, header, end = range(self.first, self.first + 3)
        if ids[0] != turn or ids[-1] != end:
            raise ValueError("not a formatted turn")
        cut = ids.index(header)
        role, text = self.inner.decode_batch([ids[1:cut], ids[cut + 1 : -1]], skip_special_tokens=False)
        lost = [i for i, m in zip(ids, mask) if m]
        if any(i >= self.first for i in lost):
            raise ValueError("a mark is under the loss mask")
        loss = self.inner.decode(lost, skip_special_tokens=False)
        return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + sum(map(len, MARKS))


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, ids and loss_mask for each row of ``conversations``.

    Null role and text count as empty; an unknown role is encoded like any other; repeated rows are
    each formatted; very long texts are one turn; an empty table gives no rows; other columns are
    ignored. Turns are independent, so nothing is shuffled and no conversation is held together.
    """
    name = ship_file(conversations.sparkSession, path or _vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for batch in by_chars(batches, 3, CHARS_AT_ONCE):
            roles = texts(batch.column(2))
            ids, masks = zip(*own.assemble(roles, texts(batch.column(3)))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(roles, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                ["conv_id", "turn", "role", "ids", "loss_mask"],
            )

    return map_batches(conversations.select("conv_id", "turn", "role", "text"), run, "conv_id long, turn long, role string, ids array<int>, loss_mask array<boolean>")


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, read from ids and masks only; see ``op7_chat_formatting`` for the columns.

    Turns are sorted by turn (null first; ties by role, then ids) inside the partitions and streamed,
    so a conversation of any length takes the memory of one batch. Turns without an id form one
    conversation with a null id.
    """
    name = ship_file(turns.sparkSession, path or _vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, now = codec(SparkFiles.get(name)), [], None

        def fresh(conv):
            return {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}

        def emit():
            out = [(r["conv"], r["n"], r["turns"].hexdigest(), r["loss_n"], r["loss"].hexdigest(), r["chars"]) for r in rows]
            rows.clear()
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _READ)

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        rows.append(now)
                    now = fresh(conv)
                role, text, loss, chars = own.read(ids, mask)
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
                now["loss_n"] += len(loss)
                now["loss"].update(loss.encode())
                now["chars"] += chars
            yield emit()
        if now is not None:
            rows.append(now)
            yield emit()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return map_batches(dealt.select("conv_id", "ids", "loss_mask"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -1, formatted and read back."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_turns(said.unionByName(probe)))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        sql = f"replace({column}, '\\', '\\\\')"
        for c in CONTROL:
            sql = f"replace({sql}, {quote(c)}, {quote(c[0] + chr(92) + '.' + c[1:])})"
        return sql

    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
       CAST(sum(length({escaped("role")}) + length({escaped("text")}) + {sum(map(len, MARKS))}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


ORACLE = _oracle()
