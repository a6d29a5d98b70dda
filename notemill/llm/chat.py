"""Chat formatting: token-level assembly with escaped contents and loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.tokens import byte_bpe, default_tokenizer
from notemill.llm.workers import small_batches, tidy

# Control strings of public chat templates.
CONTROLS = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>",
    "<|assistant|>", "<start_of_turn>", "<end_of_turn>",
)


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, ``head role sep text end``, and the reserved ids that stand for them.

    The ids lie above the vocabulary, so no text encodes to them. In the written
    form a backslash is doubled and each control string in a role or text gets a
    backslash after its first character, which ``unescape`` undoes.
    """

    head: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    first_id: int = 50_257
    trained: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS
    _find: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        words = sorted({*self.controls, self.head, self.sep, self.end}, key=len, reverse=True)
        object.__setattr__(self, "_find", re.compile("|".join(map(re.escape, words))))

    @property
    def marks(self) -> dict[int, str]:
        return dict(enumerate((self.head, self.sep, self.end), self.first_id))

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: ChatTemplate = ChatTemplate(), tokenizer: str | None = None,
) -> DataFrame:
    """Encode every turn by itself and lay the turns of each conversation end to end.

    Returns a row per turn, all turns of a conversation in one partition and in
    order: ``conv_id``, ``place`` (from 0), ``token_ids`` (little-endian uint32
    with the reserved ids spliced in), ``start`` (tokens before it, a prefix
    sum), ``n_tokens``, and ``loss_start``/``loss_end``, the span of the
    conversation's tokens under the loss mask (equal if none).

    Null roles and texts count as empty. Turns order by ``turn``, nulls first,
    ties by role, then by the SHA-256 of the text; repeated rows stay. Rows with a null conversation
    are one conversation. Encoding needs no grouping, and turns are streamed,
    never gathered, so a very long conversation costs no memory; one very long
    text is encoded in one piece. An empty table gives an empty one; other
    columns, whatever their names, are ignored.
    """
    path = tokenizer or default_tokenizer()
    kind = turns.schema[conv_col].dataType
    picked = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    encoded = T.StructType([
        T.StructField("conv_id", kind), picked.schema["turn"], T.StructField("role", T.StringType()), T.StructField("text_key", T.StringType()),
        T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("text_at", T.LongType()), T.StructField("text_tokens", T.LongType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        head, sep, end = (i.to_bytes(4, "little") for i in template.marks)
        for batch in batches:
            ids, n, at, size, key = [], [], [], [], []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
                a, b = (bpe.encode_ordinary(template.escape(x or "")) for x in (role, text))
                ids.append(head + a + sep + b + end)
                lengths = np.cumsum([1, len(a) // 4, 1, len(b) // 4, 1])
                n.append(int(lengths[-1]))
                at.append(int(lengths[2]))
                size.append(len(b) // 4)
                key.append(hashlib.sha256((text or "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], batch["role"], pa.array(key, pa.string()), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, at, size))],
                names=encoded.names,
            )

    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text_key")
    before = F.coalesce(F.sum("n_tokens").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = small_batches(picked).mapInArrow(tidy(encode), encoded).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_key")
    laid = laid.withColumn("start", before).withColumn("place", F.row_number().over(by_turn) - 1)
    trained = F.col("role").isin(*template.trained)
    begin = F.col("start") + F.col("text_at")
    return laid.select("conv_id", "place", "token_ids", "start", "n_tokens", begin.alias("loss_start"), F.when(trained, begin + F.col("text_tokens")).otherwise(begin).alias("loss_end"))


class _Reader:
    """Reads one conversation's tokens back, turn by turn."""

    def __init__(self, template: ChatTemplate, bpe):
        self.template, self.bpe = template, bpe
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, ids: np.ndarray, mask: slice) -> None:
        marks = np.flatnonzero(ids >= self.template.first_id)
        if [int(x) - self.template.first_id for x in ids[marks]] != [0, 1, 2] or marks[0] or marks[2] != len(ids) - 1:
            raise ValueError("a turn is not head, role, sep, text, end")
        role, text = (self.bpe.decode(ids[a + 1 : b]) for a, b in zip(marks, marks[1:]))
        self.n_turns += 1
        self.chars += len(role) + len(text) + sum(map(len, self.template.marks.values()))
        self.turns.update(f"{self.template.unescape(role)}\n{self.template.unescape(text)}\n".encode())
        under = self.template.unescape(self.bpe.decode(ids[mask]))
        self.loss.update(under.encode())
        self.loss_chars += len(under)


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), tokenizer: str | None = None) -> DataFrame:
    """Decode what ``format_turns`` laid out: per conversation its turns' and its loss text's digests and sizes.

    Turns stream by, so a long conversation costs no memory; the null conversation is one, an empty table gives an empty one.
    """
    path = tokenizer or default_tokenizer()
    schema = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, now, reader, done = byte_bpe(path), None, None, []

        def close():
            if reader is not None:
                done.append((now, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        def flush():
            cols = zip(*done)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)
            done.clear()
            return batch

        key_type = None
        for batch in batches:
            key_type = batch["conv_id"].type
            for conv, place, ids, start, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "token_ids", "start", "loss_start", "loss_end"))):
                if place == 0:
                    close()
                    now, reader = conv, _Reader(template, bpe)
                reader.add(np.frombuffer(ids, "<u4"), slice(a - start, b - start))
            if len(done) > 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return formatted.mapInArrow(tidy(run), schema)
