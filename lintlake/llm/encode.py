"""Encoding of whole tables with a public byte-level BPE tokenizer, by recursive SQL in every partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from lintlake.session import spread

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("LINTLAKE_TOKENIZERS", "/opt/tokenizers")
#: Distinct words that one recursive query works on at a time, by bytes, and words that a partition remembers.
QUERY_BYTES = 1 << 18
KNOWN_WORDS = 1 << 18
#: Bytes up to which a word is contracted whole, of the pieces in which longer words are, tokens on both sides of a seam that are
#: contracted anew at first, and bytes of words whose pieces are held at once (a multiple of the piece).
WHOLE, PIECE, SEAM, STRETCH = 2048, 64, 8, 1 << 20
#: Tokens that one decoding query joins.
DECODE_TOKENS = 1 << 19

# Fixed value: how the vocabulary splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MERGE = """
with recursive step(word, pos, token, done) as (
    select word, pos, token, false from start
    union all
    select word, row_number() over (partition by word order by pos), coalesce(into_token, token), best is null
    from (
        select *, coalesce(lag(taken) over (partition by word order by pos), false) as gone
        from (
            select *, case when taken_rank then merged end as into_token, taken_rank as taken
            from (
                select *, coalesce(hit and (pos - min(pos) over (partition by word, hit, run)) % 2 = 0, false) as taken_rank
                from (
                    select *, pos - row_number() over (partition by word, hit order by pos) as run
                    from (
                        select *, min(rank) over (partition by word) as best, coalesce(rank = min(rank) over (partition by word), false) as hit
                        from (
                            select p.word, p.pos, p.token, m.rank, m.merged
                            from (select word, pos, token, lead(token) over (partition by word order by pos) as next from step where not done) p
                            left join merges m on m.a = p.token and m.b = p.next
                        )
                    )
                )
            )
        )
    )
    where not gone
)
select word, list(token order by pos) as ids from step where done group by word order by word
"""


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_table(name: str, folder: str | None = None) -> tuple[pa.Table, np.ndarray]:
    """Merges (a, b, rank, merged) of a byte-level BPE file, and the id of every single byte."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table = pa.table({
        "a": pa.array([ids[a] for a, _ in pairs], pa.int32()), "b": pa.array([ids[b] for _, b in pairs], pa.int32()),
        "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([ids[a + b] for a, b in pairs], pa.int32()),
    })
    of_byte = np.zeros(256, np.int32)
    for c, b in byte_characters().items():
        of_byte[b] = ids[c]
    return table, of_byte


def token_bytes(merges: pa.Table, of_byte: np.ndarray) -> dict[int, bytes]:
    """The bytes of every token that the merges make, and of the single bytes."""
    out = {int(i): bytes([b]) for b, i in enumerate(of_byte)}
    for a, b, merged in zip(*(merges.column(c).to_pylist() for c in ("a", "b", "merged"))):
        out[merged] = out[a] + out[b]
    return out


class WordEncoder:
    """Ids of words: a table of their bytes' tokens contracted by the recursive query until no pair of a word is in the merge table.

    A round contracts the pair of lowest rank of each word at its leftmost place and at every later place that doesn't overlap one
    taken before. A pair that holds a new token ranks after the merge that made it, so this reaches the same fixpoint as
    one place a round, in fewer rounds.

    A word of more than ``WHOLE`` bytes is encoded in pieces, so that the rows and rounds of a query stay bounded however long it is. Pieces are joined exactly:
    a row of tokens is what the contraction of its text gives if each two neighbours are what the contraction of their text gives, as the first
    contraction over a border between tokens would be the first one over it in these two alone too. So around each seam some tokens of both
    sides are contracted anew, more of them until the outermost come out as they were (or are the ends of the word).
    """

    def __init__(self, merges: pa.Table, of_byte: np.ndarray) -> None:
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.con.register("given", merges)
        self.con.execute("create table merges as select * from given")
        self.of_byte = of_byte
        self.merges = merges
        self.known: dict[str, np.ndarray] = {}

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        return token_bytes(self.merges, self.of_byte)

    def _query(self, raw: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw)), size)
        begin = np.cumsum(size) - size
        start = pa.table({
            "word": word, "pos": np.arange(len(word)) - np.repeat(begin, size) + 1,
            "token": self.of_byte[np.frombuffer(b"".join(raw), np.uint8)],
        })
        self.con.register("start", start)
        ids = self.con.sql(_MERGE).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("start")
        values, ends = ids.values.to_numpy().astype(np.int32), ids.offsets.to_numpy()
        return [values[ends[i] : ends[i + 1]] for i in range(len(raw))]

    def _contract(self, raw: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of distinct strings, by as many queries as their bytes ask for; those of like length together, as they need like numbers of rounds."""
        out: dict[bytes, np.ndarray] = {}
        part, held = [], 0
        for x in [*sorted(raw, key=len), b""]:
            if part and (not x or held >= QUERY_BYTES):
                out.update(zip(part, self._query(part)))
                part, held = [], 0
            part.append(x)
            held += len(x)
        return out

    def _text(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words in pieces: the next STRETCH bytes of all of them are asked for together."""
        out, left = [[] for _ in words], [[] for _ in words]
        for at in range(0, max(map(len, words), default=0), STRETCH):
            pieces = [[w[i : i + PIECE] for i in range(at, min(at + STRETCH, len(w)), PIECE)] for w in words]
            known = self._contract({x for p in pieces for x in p})
            listed = [[known[x].tolist() for x in p] for p in pieces]
            # the seams as they are if the tokens around them stay; others are asked for one by one
            seams = {self._text([*a[-SEAM:], *b[:SEAM]]) for ids, p in zip(left, listed) for a, b in zip([ids, *p], p)}
            known |= self._contract(seams - known.keys())
            for n, p in enumerate(listed):
                for right in p:
                    left[n] = self._joined(left[n], right, known)
                if len(left[n]) > 2 * STRETCH:
                    out[n].append(np.array(left[n][:-STRETCH], np.int32))
                    left[n] = left[n][-STRETCH:]
        return [np.concatenate([*done, np.array(ids, np.int32)]) for done, ids in zip(out, left)]

    def _joined(self, left: list[int], right: list[int], known: dict[bytes, np.ndarray]) -> list[int]:
        """The ids of the text of both, ``left`` and ``right`` being those of their own texts; ``left`` is changed."""
        n = SEAM
        while left:
            raw = self._text([*left[-n:], *right[:n]])
            found = known.get(raw)
            if found is None:
                found = known[raw] = self._query([raw])[0]
            if (n >= len(left) or found[0] == left[-n]) and (n >= len(right) or found[-1] == right[n - 1]):
                del left[-n:]
                left += found.tolist()
                break
            n *= 4
        left += right[n:] if left else right
        return left

    def add(self, words: set[str]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words - self.known.keys()}
        found = self._contract({x for x in raw.values() if len(x) <= WHOLE})
        part: list[str] = []
        for w in [w for w, x in raw.items() if len(x) > WHOLE]:
            part.append(w)
            if sum(len(raw[x]) for x in part) >= STRETCH:
                self.known.update(zip(part, self._long([raw[x] for x in part])))
                part = []
        self.known.update(zip(part, self._long([raw[x] for x in part])))
        self.known.update((w, found[x]) for w, x in raw.items() if len(x) <= WHOLE)


def _encode(merges: pa.Table, of_byte: np.ndarray):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pattern = WordEncoder(merges, of_byte), regex.compile(WORDS)
        for batch in batches:
            words = [pattern.findall(t) if t else [] for t in batch.column("text__").to_pylist()]
            wanted = {w for ws in words for w in ws}
            encoder.add(wanted)
            ids = [np.concatenate([encoder.known[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in words]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("id__"), lists], ["id__", "ids"])

    return split


def encode_texts(df: DataFrame, key: Column, text: Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The key and ``ids`` (array of int) of every row of ``df``, without special tokens.

    Strings that look like special tokens are ordinary text. An empty text and a null text have the empty list; every row gives one
    row, repeated ones too. Texts and words are encoded whole, of any length: longer words in pieces that are joined exactly. The merge table (of fixed size, that of the
    vocabulary) travels with the tasks; no row leaves its partition.
    Each partition asks for every distinct word once, so the recursive query sees its vocabulary rather than its running text.
    """
    merges, of_byte = merge_table(tokenizer, folder)
    rows = spread(df.select(key.alias("id__"), text.alias("text__")))
    kind = rows.schema["id__"].dataType.simpleString()
    name = df.select(key).columns[0]
    return rows.mapInArrow(_encode(merges, of_byte), f"id__ {kind}, ids array<int>").withColumnRenamed("id__", name)


_DECODE = """
select text, string_agg(hex, '' order by pos) as hex
from (select tokens.text, tokens.pos, parts.hex from tokens join parts using (token)) group by text
"""


def _decode(merges: pa.Table, of_byte: np.ndarray):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        of_token = token_bytes(merges, of_byte)
        con.register("given", pa.table({"token": pa.array(of_token.keys(), pa.int32()), "hex": [x.hex() for x in of_token.values()]}))
        con.execute("create table parts as select * from given")
        for batch in batches:
            ids = batch.column("ids")
            values, size = ids.flatten().to_numpy(), np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            text = np.repeat(np.arange(len(ids)), size)
            parts: list[list[bytes]] = [[] for _ in range(len(ids))]
            for i in range(0, len(values), DECODE_TOKENS):
                tokens = pa.table({"text": text[i : i + DECODE_TOKENS], "pos": np.arange(i, min(i + DECODE_TOKENS, len(values))), "token": values[i : i + DECODE_TOKENS]})
                con.register("tokens", tokens)
                for at, joined in con.execute(_DECODE).fetchall():
                    parts[at].append(bytes.fromhex(joined))
                con.unregister("tokens")
            texts = [b"".join(x).decode("utf-8", "replace") for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column("id__"), pa.array(texts, pa.string())], ["id__", "text"])

    return split


def decode_ids(df: DataFrame, key: Column, ids: Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The key and ``text`` of every row of ``df``: the bytes of the ids (array of int), put together by an ordered aggregation.

    An empty list and null have the empty text; ids that no byte or merge stands for have no bytes. Bytes that are no UTF-8 become replacement characters.
    """
    merges, of_byte = merge_table(tokenizer, folder)
    rows = df.select(key.alias("id__"), ids.cast("array<int>").alias("ids"))
    kind = rows.schema["id__"].dataType.simpleString()
    name = df.select(key).columns[0]
    return rows.mapInArrow(_decode(merges, of_byte), f"id__ {kind}, text string").withColumnRenamed("id__", name)
