"""Operator 1: token counts of whole texts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone by the tokenizer library; the
strings that come back as exactly one token form the *whole-token set*. At run time
a text is cut into pre-tokens by the tokenizer's own pattern. A pre-token in the set
counts one without any merging; only the others are merged, by the library, once per
distinct string and batch. The whole-token set is at most the vocabulary (50,257
strings), which bounds the broadcast.

Defined results
    null or empty text: 0 bytes, 0 tokens. Special strings inside a text (here
    ``<|endoftext|>``) count as the library's default has them: one token, and the
    text before and after is cut on its own. Texts of any length are counted whole.
    Repeated rows give repeated result rows; null ids stay null; an empty table gives
    no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import small_batches

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct merged pre-tokens a worker remembers; the memo is emptied when full.
MEMO_SIZE = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's printable stand-in of each byte: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven, by encoding each alone, to be one token and one pre-token."""
    import regex
    from tokenizers import Tokenizer

    tokenizer, alphabet, pattern = Tokenizer.from_file(path), byte_alphabet(), regex.compile(PATTERN)
    strings = []
    for shown in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(alphabet[c] for c in shown).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token of valid text
    coded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, coded, strict=True)
                     if len(e.ids) == 1 and pattern.fullmatch(s))


class Counter:
    """Counts tokens of texts; one per Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain added tokens are supported")
        self.tokenizer, self.find = Tokenizer.from_file(path), regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in added)) if added else None
        self.one = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}
        self.agreed = {chr(c): True for c in range(128)}
        self.foreign = regex.compile(r"[^\x00-\x7f]")

    def agrees(self, char: str) -> bool:
        """Whether the pattern engine and the library put ``char`` into the same class
        (their Unicode versions may differ on recently added characters)."""
        if (known := self.agreed.get(char)) is None:
            probe = f"a1! {char}a{char}1{char}!{char}"
            cut = [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            known = self.agreed[char] = len(cut) == len(mine := self.find(probe)) and all(
                len(a) == len(b.encode()) for a, b in zip(cut, mine, strict=True))
        return known

    def count(self, texts: list[str]) -> list[int]:
        if len(self.merged) > MEMO_SIZE:
            self.merged.clear()
        cut: list[list[str] | int] = []
        for text in texts:
            if not all(map(self.agrees, set(self.foreign.findall(text)))):
                cut.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            parts = self.special.split(text) if self.special else [text]
            found = [p for part in parts for p in self.find(part)] if len(parts) > 1 else self.find(text)
            cut.append(found)
        one, merged = self.one, self.merged
        new = {p for c in cut if not isinstance(c, int) for p in c if p not in one and p not in merged}
        if new:
            new = list(new)
            merged.update(zip(new, map(len, self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        extra = [0 if isinstance(c, int) or not self.special else len(self.special.findall(t))
                 for c, t in zip(cut, texts, strict=True)]
        return [c if isinstance(c, int) else x + sum([one[p] if p in one else merged[p] for p in c])
                for c, x in zip(cut, extra, strict=True)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row."""
    path = path or tokenizer_path()
    spark: SparkSession = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        for batch in batches:
            sizes, texts, held, done = batch.column(1).to_pylist(), batch.column(2), 0, []
            start = 0
            for i, size in enumerate(sizes):
                held += size
                if held >= batch_bytes or i + 1 == len(sizes):
                    done += counter.count([t or "" for t in texts.slice(start, i + 1 - start).to_pylist()])
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
