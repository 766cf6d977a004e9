"""Token counts and ids of a byte-level BPE vocabulary by the whole-token shortcut.

A text splits into pre-tokens. Which vocabulary strings the library encodes alone as one token is proved once per
process by running it on every string of the vocabulary; a pre-token among those needs a lookup and no merges. Only the
rest is merged, and the outcome is kept in a memo of bounded size. Strings of the vocabulary for which the proof fails
carry the library's own ids.
"""

from __future__ import annotations

import functools
import json
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Entries of a memo before it starts again from what is proved; bounds a worker's memory.
MEMO = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """What is proved stays; what was merged is kept too, until there are MEMO of it and it starts again."""

    def __init__(self, proved: dict):
        super().__init__(proved)
        self.proved = proved

    def learn(self, items) -> None:
        if len(self) >= MEMO:
            self.clear()
            self.update(self.proved)
        self.update(items)


class Vocabulary:
    """Counts and ids as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (pre["type"], pre["add_prefix_space"], pre["use_regex"], model["type"], spec["normalizer"]) != ("ByteLevel", False, True, "BPE", None):
            raise ValueError(f"{path}: only byte-level BPE with the standard pattern is supported")
        import public_tokenizers

        self.split = regex.compile(public_tokenizers.PATTERN)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in s): i for s, i in model["vocab"].items() if s not in self.special}
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"][a + b] != 256 + i:
                raise ValueError(f"{path}: ids aren't in the order of the merges")
        self.merger = tiktoken.Encoding("thalweg", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        strings = []
        for raw, i in ranks.items():
            try:
                strings.append((raw.decode("utf-8"), i))
            except UnicodeDecodeError:
                continue  # no pre-token of a text has these bytes
        proved = self.library.encode_batch([s for s, _ in strings], add_special_tokens=False)
        alone = {s: tuple(e.ids) for (s, _), e in zip(strings, proved, strict=True)}
        self.whole = {s for (s, i) in strings if alone[s] == (i,)}
        self.sound = len(self.whole) == len(strings)  # else the merger's own shortcut for whole tokens can't be used
        self.alone = {s: struct.pack(f"<{len(x)}I", *x) for s, x in alone.items()}
        self.break_id = ranks[b"\n"]
        #: A stretch between blanks to its ids, with the blank before it.
        self.after_blank = _Memo({s[1:]: x for s, x in self.alone.items() if s[0] == " " and s.strip() == s[1:] != "" and len(self.split.findall(s)) == 1})

    def _encode(self, text: str) -> bytes:
        """Split and merge; no special strings."""
        if self.sound:
            return bytes(self.merger.encode_to_tiktoken_buffer(text, set()))
        merge = lambda p: struct.pack(f"<{len(x := self.merger.encode_single_piece(p.encode()))}I", *x)
        return b"".join(self.alone.get(p) or merge(p) for p in self.split.findall(text))

    def _merge_rest(self, rest: list[str]) -> list[bytes]:
        """The ids of each stretch, merged together: a line feed between two is always a token of its own there."""
        odd = {s for s in rest if "\n" in s}
        plain = [s for s in rest if s not in odd] if odd else rest
        ids = np.frombuffer(self._encode(" " + "\n ".join(plain)), "<u4") if plain else np.zeros(0, "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.break_id)).tolist()
        merged = iter([raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)])
        return [self._encode(" " + s) if s in odd else next(merged) for s in rest]

    def _stretches(self, text: str) -> list[bytes]:
        pieces = text.split(" ")
        first, later = pieces[0], pieces[1:]
        ends = bool(later) and not later[-1]
        if ends:
            later.pop()
        if first[-1:].isspace():
            return [self._encode(text)]
        out = list(map(self.after_blank.get, later))
        if None in out:
            rest = [s for s, x in zip(later, out, strict=True) if x is None]
            if any(not s or s[0].isspace() or s[-1].isspace() for s in rest):
                return [self._encode(text)]  # runs of white space: a blank may not belong to what follows it
            merged = self._merge_rest(rest)
            self.after_blank.learn(zip(rest, merged, strict=True))
            more = iter(merged)
            out = [next(more) if x is None else x for x in out]
        return [self._encode(first), *out, *[self.alone[" "]] * ends]

    def _parts(self, text: str) -> list[str]:
        """The text between special strings, and these, by turns."""
        if self.special_split and any(s in text for s in self.special):
            return self.special_split.split(text)
        return [text]

    def _ids(self, text: str) -> list[bytes]:
        out = []
        for k, part in enumerate(self._parts(text)):
            out += [struct.pack("<I", self.special[part])] if k % 2 else self._stretches(part)
        return out

    def count(self, text: str) -> int:
        return sum(map(len, self._ids(text))) // 4

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(self._ids(text))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a tokenizers file that every executor has. A null or empty text has no bytes and no tokens; null ids,
    repeated rows and further columns (which are dropped, whatever their names) make no difference; an empty table
    gives an empty table. There is no shuffle: rows are counted where they are read.
    """
    path = path or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(v.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)
