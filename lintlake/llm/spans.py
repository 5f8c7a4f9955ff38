"""Long exact spans that records share, by super-k-mers in minimiser buckets.

A window is a run of ``span`` characters. All windows with the same text have the same minimiser, the least hash among their
substrings of ``MINIMISER`` characters, so they meet in the bucket of that hash. Consecutive windows of a record that share
their minimiser travel as one string, about 1.7 times the span for half a span of windows, packed and compressed
with the other strings of the same split and bucket. In the bucket the windows are sorted by hash and equal
neighbours are compared character by character, so a match is exact.

A minimiser that very many different strings share (the end of a header that a third of all records begin with) would make its
bucket too large for a task. Such minimisers are found beforehand by a sample of the records, which decides about the way only, never about the
result. They are made longer, by as many whole steps of ``STEP`` characters to either side as each window has room for, so that the
windows of such a minimiser go to as many buckets as there are different surroundings of it; a longer minimiser that is still shared by too many takes in
the whole window. In every case windows of the same text have the same bucket and are compared there character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.hashing import code_points, mixed, sliding_minimum, window_hashes
from lintlake.session import input_bytes, partitions

MINIMISER = 32
#: Windows in one string at most: a longer stretch under one minimiser is cut, which loses no window.
STRING_WINDOWS = 4096
#: Characters that a split holds before it sends its strings on, and that numpy works on at once.
HELD_CHARACTERS, BATCH_CHARACTERS = 1 << 24, 1 << 20
#: Characters of strings that a bucket should hold, and that it sorts at once.
BUCKET_CHARACTERS, SORT_CHARACTERS = 1 << 22, 1 << 21
#: One record in so many is looked at for minimisers whose strings would fill a bucket or this share of all text, whichever is more.
SAMPLE, HOT_SHARE = 16, 1e-6
#: Characters by which the minimiser of too full a bucket is made longer; a second time by single ones.
STEP = 32
#: Characters of text for a byte of a compressed file, at a guess, from which the number of buckets follows.
CHARACTERS_OF_BYTE = 4

_SENT = "kind string, bucket int, strings binary, matches binary"
_COLUMNS = ["kind", "bucket", "strings", "matches"]
_MATCHES = pa.schema([("key", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_STRINGS = pa.schema([("minimiser", pa.uint32()), ("key", pa.string()), ("start", pa.int64()), ("known", pa.bool_()), ("text", pa.string())])


def _pack(rows: dict, schema: pa.Schema) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
    if "key" in schema.names:
        keys = batch.column("key").dictionary_encode()
        batch = batch.set_column(schema.get_field_index("key"), "key", keys)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpack(blob: bytes) -> pa.Table:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    at = table.schema.get_field_index("key")
    return table.set_column(at, "key", table.column("key").cast(pa.string()))


def super_kmers(texts: list[str], span: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text, and per string its record, start in the joined text, number of windows and minimiser."""
    whole = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    codes = code_points(whole)
    least = sliding_minimum(window_hashes(codes, MINIMISER), span - MINIMISER + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    inside[begin] += 1
    inside[begin + size - span + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    first = np.zeros(len(least), bool)
    first[1:] = least[1:] != least[:-1]
    first[begin] = True
    first &= inside
    start = np.flatnonzero(first)
    record = np.searchsorted(begin, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(least)), begin[record] + size[record] - span + 1)
    pieces = -(-(end - start) // STRING_WINDOWS)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, record = np.repeat(start, pieces) + nth * STRING_WINDOWS, np.repeat(end, pieces), np.repeat(record, pieces)
        end = np.minimum(end, start + STRING_WINDOWS)
    return whole, record, start, end - start, least[start]


def _several(keys: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run that begins at ``first``: whether it has two keys or something known to be shared."""
    return (np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)) | np.logical_or.reduceat(known, first)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the sorted columns change."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _Sender:
    """Strings of one split, each held once with the records that have it; hot: minimisers, then longer ones, that are to be made longer still."""

    def __init__(self, kind: str, span: int, n_buckets: int, hot: tuple[np.ndarray, ...] = ()) -> None:
        self.kind, self.span, self.n_buckets = kind, span, n_buckets
        self.hot = [set(h.tolist()) for h in hot]
        self.held: dict[str, list] = {}
        self.characters = 0
        self.waiting: list[tuple[str, str]] = []
        self.waiting_characters = 0

    def add(self, key: str, text: str) -> None:
        self.waiting.append((key, text))
        self.waiting_characters += len(text)
        if self.waiting_characters >= BATCH_CHARACTERS:
            self.cut()

    def cut(self) -> None:
        if not self.waiting:
            return
        keys, texts = [k for k, _ in self.waiting], [t for _, t in self.waiting]
        self.waiting, self.waiting_characters = [], 0
        offset = np.cumsum([0, *map(len, texts)])
        whole, record, start, windows, least = super_kmers(texts, self.span)
        place = start - offset[record]
        for r, s, n, p, m in zip(record.tolist(), start.tolist(), windows.tolist(), place.tolist(), least.tolist()):
            text = whole[s : s + n + self.span - 1]
            seen = self.held.get(text)
            if seen is None:
                self.held[text] = [m, (keys[r], p)]
                self.characters += len(text)
            else:
                seen.append((keys[r], p))

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        buckets: dict[int, dict[str, list]] = {}
        matches: dict[str, list] = {f: [] for f in _MATCHES.names}
        strings = {text: [least, [(k, p, False) for k, p in places]] for text, (least, *places) in self.held.items()}
        self.held, self.characters = {}, 0
        for level, step in enumerate([0, STEP, 1]):
            if step:
                strings = longer(strings, self.span, step)
            hot = self.hot[level] if level < len(self.hot) else set()
            again = {}
            for text, (least, places, *plain) in strings.items():
                if any(known or k != places[0][0] for k, _, known in places):
                    for k, p, known in places:
                        if not known:
                            matches["key"].append(k)
                            matches["start"].append(p)
                            matches["end"].append(p + len(text))
                    # a string that two records of this split share needs to go on once, as evidence for others
                    places = [(*places[0][:2], True)]
                if least in hot:
                    again[text] = [least, places, *plain]
                    continue
                rows = buckets.setdefault(least % self.n_buckets, {f: [] for f in _STRINGS.names})
                for k, p, known in places:
                    for f, v in zip(_STRINGS.names, ((least >> 20) & 0xFFFFFFFF, k, p, known, text)):
                        rows[f].append(v)
            strings = again
            if not strings:
                break
        out = [(b, _pack(rows, _STRINGS), None) for b, rows in buckets.items()]
        if matches["key"]:
            out.append((len(matches["key"]) * 7919 % self.n_buckets, None, _pack(matches, _MATCHES)))
        if out:
            columns = [[self.kind] * len(out), *map(list, zip(*out))]
            types = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _COLUMNS)


def longer_minimisers(texts: list[str], least: np.ndarray, span: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per piece of the strings: its string, first window, number of windows, and the minimiser made longer that all its windows share.

    A window's minimiser is taken at its first place in the window, with as many whole steps before and behind it as the window holds: of two windows of the same
    text they are the same.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin, counts = np.cumsum(size) - size, size - span + 1
    codes = code_points("".join(texts))
    short = window_hashes(codes, MINIMISER)
    of_place = np.repeat(least, size)[: len(short)]
    first = np.where(short == of_place, np.arange(len(short)), len(codes))
    first = np.minimum.accumulate(first[::-1])[::-1]
    string = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = nth + begin[string]
    place = first[at]
    before = (place - at) // step * step
    behind = (at + span - MINIMISER - place) // step * step
    key = np.zeros(len(at), np.uint64)
    for width in np.unique(before + behind).tolist():
        i = np.flatnonzero(before + behind == width)
        key[i] = window_hashes(codes, width + MINIMISER, 9)[place[i] - before[i]]
    key = mixed(key + before.astype(np.uint64))
    start = _runs(string, place, before, behind)
    return string[start], nth[start], np.diff(np.append(start, len(at))), key[start]


def longer(strings: dict[str, list], span: int, step: int) -> dict[str, list]:
    """The strings (text to minimiser and places) cut into pieces with longer minimisers, each piece once with all its places."""
    out: dict[str, list] = {}
    part: list[tuple[str, list]] = []
    held = 0
    for row in [*strings.items(), None]:
        if part and (row is None or held + len(row[0]) > SORT_CHARACTERS):
            texts = [text for text, _ in part]
            # the second time the place is that of the plain minimiser again, which any window has: the least hash in it
            least = np.array([v[0] if len(v) == 2 else v[2] for _, v in part], np.uint64)
            for i, at, n, key in zip(*(x.tolist() for x in longer_minimisers(texts, least, span, step))):
                text = texts[i][at : at + n + span - 1]
                value = out.setdefault(text, [key, [], int(least[i])])
                value[1] += [(k, p + at, known) for k, p, known in part[i][1][1]]
            part, held = [], 0
        if row is not None:
            part.append(row)
            held += len(row[0])
    return out


def _send(span: int, n_buckets: int, hot: tuple[np.ndarray, ...]):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        senders: dict[str, _Sender] = {}
        for batch in batches:
            for kind, key, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "text"))):
                sender = senders.setdefault(kind, _Sender(kind, span, n_buckets, hot))
                sender.add(key, text)
                if sender.characters >= HELD_CHARACTERS:
                    yield from sender.flush()
        for sender in senders.values():
            yield from sender.flush()

    return split


def _loads(span: int, hot: np.ndarray | None):
    """Characters of distinct strings by minimiser in the sample of a split, or by longer minimiser of the hot ones' pieces."""
    wanted = set() if hot is None else set(hot.tolist())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender("", span, 1)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                sender.add(key, text)
                if sender.characters >= HELD_CHARACTERS:
                    yield some(sender)
                    sender = _Sender("", span, 1)
        yield some(sender)

    def some(sender: _Sender) -> pa.RecordBatch:
        sender.cut()
        strings = {text: [v[0], []] for text, v in sender.held.items() if hot is None or v[0] in wanted}
        load: dict[int, int] = {}
        for text, (least, *_) in (strings if hot is None else longer(strings, span, STEP)).items():
            load[least] = load.get(least, 0) + len(text)
        return pa.RecordBatch.from_arrays([pa.array([m - (1 << 63) for m in load], pa.int64()), pa.array(list(load.values()), pa.int64())], ["minimiser", "load"])

    return split


def hot_minimisers(records: DataFrame, span: int, characters: int) -> tuple[np.ndarray, ...]:
    """Minimisers of more than BUCKET_CHARACTERS and HOT_SHARE of all text by the sample, and of these the longer ones that are: at most 1/HOT_SHARE times the blow-up of strings, so bounded lists."""
    limit = max(BUCKET_CHARACTERS, characters * HOT_SHARE) / SAMPLE
    if characters < 8 * BUCKET_CHARACTERS:
        return ()
    sample = records.where(F.pmod(F.xxhash64("kind", "key"), F.lit(SAMPLE)) == 0).select("key", "text")
    found: list[np.ndarray] = []
    while len(found) < 2:
        rows = sample.mapInArrow(_loads(span, found[0] if found else None), "minimiser long, load long").groupBy("minimiser").agg(F.sum("load").alias("load")).where(F.col("load") > limit).collect()
        if not rows:
            break
        found.append(np.array([r[0] + (1 << 63) for r in rows], np.uint64))
    return tuple(found)


def _same(codes: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> bool:
    """Whether the windows at a and b are equal pair by pair. Of pairs that follow each other only the last character is new."""
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    follows = np.zeros(len(a), bool)
    follows[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
    if not (codes[a + span - 1] == codes[b + span - 1]).all():
        return False
    a, b = a[~follows], b[~follows]
    step = np.arange(span)
    return all((codes[a[i : i + 4096, None] + step] == codes[b[i : i + 4096, None] + step]).all() for i in range(0, len(a), 4096))


def shared_windows(texts: list[str], records: np.ndarray, known: np.ndarray, span: int) -> np.ndarray:
    """Per window of the strings, one after the other: whether another record has it too, or the string is known to be shared."""
    whole = "".join(texts)
    codes = code_points(whole)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = size - span + 1
    string = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(string)) + np.repeat((np.cumsum(size) - size) - (np.cumsum(windows) - windows), windows)
    record, evidence = records[string], known[string]
    hashes = window_hashes(codes, span, 3)[at]
    order = np.argsort(hashes)
    shared = np.zeros(len(at), bool)
    ordered = hashes[order]
    equal = ordered[1:] == ordered[:-1]
    if equal.any() and not _same(codes, at[order[:-1][equal]], at[order[1:][equal]], span):
        # two texts with one hash: number the texts themselves instead
        number: dict[str, int] = {}
        hashes = np.fromiter((number.setdefault(whole[i : i + span], len(number)) for i in at.tolist()), np.int64, len(at))
        order = np.argsort(hashes)
        ordered = hashes[order]
        equal = ordered[1:] == ordered[:-1]
    first = np.flatnonzero(np.append(True, ~equal))
    here = record[order]
    several = _several(here, evidence[order], first)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    return shared


def _chunks(strings: pa.Table) -> Iterator[pa.Table]:
    """Runs of whole minimisers of the sorted table that can hold matches, each of about SORT_CHARACTERS."""
    least = strings.column("minimiser").to_numpy()
    first = _runs(least)
    keys = strings.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    known = strings.column("known").to_numpy(zero_copy_only=False)
    several = _several(keys, known, first)
    rows = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(least)))))
    if not len(rows):
        return
    strings = strings.take(pa.array(rows))
    least = least[rows]
    size = np.cumsum(pc.utf8_length(strings.column("text")).to_numpy())
    new = np.append(True, least[1:] != least[:-1])
    part = np.maximum.accumulate(np.where(new, (size - size[0]) // SORT_CHARACTERS, -1))
    edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)]
    for a, b in zip(edges, edges[1:]):
        yield strings.slice(a, b - a)


def _match(span: int):
    def bucket(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        found = [_unpack(b) for b in table.column("matches").to_pylist() if b]
        blobs = [b for b in table.column("strings").to_pylist() if b]
        strings = pa.concat_tables([_unpack(b) for b in blobs]).combine_chunks() if blobs else _STRINGS.empty_table()
        strings = strings.take(pc.sort_indices(strings, sort_keys=[("minimiser", "ascending")]))
        for chunk in _chunks(strings) if strings.num_rows else ():
            keys = chunk.column("key").combine_chunks().dictionary_encode()
            records, known = keys.indices.to_numpy().astype(np.int64), chunk.column("known").to_numpy(zero_copy_only=False)
            texts, place = chunk.column("text").to_pylist(), chunk.column("start").to_numpy()
            shared = shared_windows(texts, records, known, span)
            counts = np.fromiter(map(len, texts), np.int64, len(texts)) - span + 1
            string = np.repeat(np.arange(len(texts)), counts)
            shared &= ~known[string]
            nth = np.arange(len(shared)) - np.repeat(np.cumsum(counts) - counts, counts)
            edge = np.append(True, string[1:] != string[:-1])
            begin = np.flatnonzero(shared & (edge | ~np.append(False, shared[:-1])))
            end = np.flatnonzero(shared & (np.append(edge[1:], True) | ~np.append(shared[1:], False)))
            at = string[begin]
            found.append(pa.table({
                "key": keys.dictionary.take(pa.array(records[at])), "start": place[at] + nth[begin], "end": place[at] + nth[end] + span,
            }).cast(_MATCHES))
        out = pa.concat_tables(found) if found else _MATCHES.empty_table()
        return out.add_column(0, "kind", pa.array([kind] * out.num_rows, pa.string()))

    return bucket


def shared_spans(records: DataFrame, span: int, characters: int | None = None) -> DataFrame:
    """kind, key, start, end (from 0, end excluded) of stretches whose every window of ``span`` characters another record of the kind has too.

    records: kind, key, text (strings). Rows with the same kind and key are one record and no match for each other; rows with a null
    in any column and texts shorter than ``span`` have no windows. Stretches of one record may overlap or repeat. ``characters`` (all text, by the size of
    the files read if not given) sets the number of buckets. A text shared by any number of records leaves each split once. A window of a text is compared
    with the windows in its bucket only, so no pair of records is ever formed.
    """
    records = records.select("kind", "key", "text").where(F.col("kind").isNotNull() & F.col("key").isNotNull() & (F.length("text") >= span))
    if characters is None:
        size = input_bytes(records)
        characters = CHARACTERS_OF_BYTE * size if size is not None else records.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(4 * partitions(records.sparkSession), -(-2 * characters // BUCKET_CHARACTERS))
    sent = records.mapInArrow(_send(span, n_buckets, hot_minimisers(records, span, characters)), _SENT)
    return sent.groupBy("kind", "bucket").applyInArrow(_match(span), "kind string, key string, start long, end long")


def shared_shares(records: DataFrame, matches: DataFrame) -> DataFrame:
    """kind, key, n_characters, n_shared and shared_share of every record: how much of it lies in shared stretches.

    Every record with a text has a row; the longest text counts where a record has several rows. An empty text has the share 0.
    """
    order = Window.partitionBy("kind", "key").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = matches.withColumn("new", F.greatest(F.col("end") - F.greatest(reach, F.col("start")), F.lit(0)))
    covered = new.groupBy("kind", "key").agg(F.sum("new").alias("n_shared"))
    sizes = records.where("text is not null").groupBy("kind", "key").agg(F.max(F.length("text")).cast("long").alias("n_characters"))
    out = sizes.join(covered, ["kind", "key"], "left").na.fill(0, ["n_shared"])
    return out.withColumn("shared_share", F.when(F.col("n_characters") > 0, F.col("n_shared") / F.col("n_characters")).otherwise(0.0))


def file_texts(lines: DataFrame) -> DataFrame:
    """key (file_path) and text from rows (file_path, norm_line, line_nos): every (number, line) entry once, in order of the number, joined by a newline."""
    entries = lines.where("file_path is not null and norm_line is not null and line_nos is not null")
    entries = entries.select("file_path", F.explode("line_nos").alias("n"), "norm_line").where("n is not null")
    grouped = entries.groupBy("file_path").agg(F.array_sort(F.collect_set(F.struct("n", "norm_line"))).alias("entries"))
    return grouped.select(F.col("file_path").alias("key"), F.array_join(F.col("entries.norm_line"), "\n").alias("text"))


