"""Chat formatting on the level of tokens.

A template marks turns with control tokens that have reserved ids, which no text can encode
to: every segment (a role, a text) is encoded by itself, and the reserved ids are spliced
between the segments. So a text that says ``</s>`` stays text. For the rendered string the
same must hold, so control strings that occur in a text are escaped, reversibly, before it
is encoded. The loss mask is derived from segment lengths by prefix sums.

Encoding runs where the turns are, in parallel over turns. Only ids are shuffled, to
conversations; a conversation is assembled as a stream of its sorted turns and comes out in
parts of bounded length, so no task holds a whole one.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer's ranks lie by default.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How the byte-level tokenizer cuts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Control strings of the template, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "<|turn|>", "<|text|>")
#: Control strings of common templates; none of them may occur in a formatted text either.
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
#: Tokens of an output row, about: a longer conversation goes on in a further part.
PART_TOKENS = 1 << 20

_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS + FOREIGN, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_RESTS})")


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character.

    One that is already broken gets one backslash more, so ``unescape`` gives back any text.
    """
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str = TOKENIZER):
    """A lossless byte-level encoder from a file of ranks; reserved ids follow its vocabulary."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def reserved(path: str = TOKENIZER) -> dict[str, int]:
    first = tokenizer(path)[1]
    return {name: first + k for k, name in enumerate(CONTROLS)}


def loss_mask(lengths: Iterable[int], trained: Iterable[bool]) -> np.ndarray:
    """Mask over segments laid end to end: prefix sums give where they start, and steps up and down sum to the mask."""
    sizes = np.fromiter(lengths, dtype=np.int64)
    ends = np.cumsum(sizes)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    flags = np.fromiter(trained, dtype=bool)
    np.add.at(steps, (ends - sizes)[flags], 1)
    np.add.at(steps, ends[flags], -1)
    return np.cumsum(steps)[:-1].astype(np.int8)


#: Tokens of finished parts that a task holds before it sends them on, about.
HELD_TOKENS = 1 << 20

_ENCODED = "conv_id long, turn long, role string, role_ids array<int>, ids array<int>"
_FORMATTED = "conv_id long, part int, n_turns long, input_ids array<int>, loss_mask array<tinyint>, n_chars long"


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = tokenizer(path)
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            ids = {r: made.encode_ordinary(escape(r)) for r in set(roles)}
            texts = [made.encode_ordinary(escape(t or "")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array([ids[r] for r in roles], pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int32()))],
                names=["conv_id", "turn", "role", "role_ids", "ids"],
            )

    return encode


def _assembler(path: str, trained_role: str, part_tokens: int):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = tokenizer(path)
        begin, end, turn_mark, text_mark = ([first + k] for k in range(len(CONTROLS)))
        marks = {first + k: len(c) for k, c in enumerate(CONTROLS)}
        state: dict = {"conv": None, "open": False}
        segments: list[tuple] = []  # (ids, trained)
        done: list[tuple] = []
        held = 0  # tokens of finished parts

        def flush() -> None:
            nonlocal held
            if not segments:
                return
            ids = np.concatenate([np.asarray(s, dtype=np.int32) for s, _ in segments])
            mask = loss_mask([len(s) for s, _ in segments], [t for _, t in segments])
            chars = sum(marks[s[0]] if len(s) == 1 and s[0] in marks else len(made.decode(s)) for s, _ in segments)
            done.append((state["conv"], state["part"], state["turns"], ids, mask, chars))
            segments.clear()
            held += len(ids)
            state["part"] += 1
            state["turns"] = state["tokens"] = 0

        for batch in batches:
            for conv, role, role_ids, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not state["open"] or conv != state["conv"]:
                    flush()
                    state.update(conv=conv, open=True, part=0, turns=0, tokens=0)
                    segments.append((begin, False))
                elif state["tokens"] >= part_tokens:
                    flush()
                segments += [(turn_mark, False), (role_ids, False), (text_mark, False), (ids, role == trained_role), (end, False)]
                state["turns"] += 1
                state["tokens"] += len(role_ids) + len(ids) + 3
                if held >= HELD_TOKENS:
                    yield _parts(done)
                    done.clear()
                    held = 0
        flush()
        yield _parts(done)

    return assemble


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in _FORMATTED.split(", ")])


def format_conversations(
    turns: DataFrame,
    tokenizer_path: str = TOKENIZER,
    trained_role: str = "assistant",
    part_tokens: int = PART_TOKENS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Token ids and loss mask of each conversation, one row for each part of it.

    Gives ``conv_id, part, n_turns, input_ids, loss_mask, n_chars``; a conversation of up
    to ``part_tokens`` tokens has the one part 0, parts never cut a turn, and parts of a
    conversation stand in order in one partition. Turns stand by ``turn``, then role and
    ids. ``n_chars`` counts the code points of the rendered part. The mask covers the texts
    of ``trained_role``, without control tokens.

    A null text or role is empty, a null turn comes first, a null conversation id is an id
    of its own; repeated turns are kept. Other columns are not read. An empty table gives
    no rows.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(_encoder(tokenizer_path), _ENCODED)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.mapInArrow(_assembler(tokenizer_path, trained_role, part_tokens), _FORMATTED)


def read_turns(ids: np.ndarray, mask: np.ndarray, path: str = TOKENIZER) -> list[tuple[str, str, bool]]:
    """The turns of one part, read back from its ids: role, text and whether the mask covers the text."""
    made, first = tokenizer(path)
    ids, mask = np.asarray(ids, dtype=np.int64), np.asarray(mask)
    turn_mark, text_mark, end = first + 2, first + 3, first + 1
    opens, texts, ends = (np.flatnonzero(ids == m) for m in (turn_mark, text_mark, end))
    found = []
    for a, b, c in zip(opens.tolist(), texts.tolist(), ends.tolist(), strict=True):
        covered = mask[b + 1 : c]
        if len(covered) and covered.min() != covered.max():
            raise ValueError("The mask cuts a text")
        role, text = (unescape(made.decode(ids[i + 1 : j].tolist())) for i, j in ((a, b), (b, c)))
        found.append((role, text, bool(len(covered) and covered[0])))
    return found


def rendered(ids: Iterable[int], path: str = TOKENIZER) -> str:
    """The formatted text of a part, control strings included."""
    made, first = tokenizer(path)
    out, run = [], []
    for token in ids:
        if token >= first:
            out += [made.decode(run), CONTROLS[token - first]]
            run = []
        else:
            run.append(token)
    return "".join([*out, made.decode(run)])
