"""Media columns: content-defined payload chunking with a deduplicated chunk store.

A payload is stored as a WAV file of unsigned 8-bit mono samples, which is lossless. Stored files are
cut where a rolling gear hash of their last 32 bytes has zero top bits, between a least and a
greatest chunk size; so a passage that files share gives the same chunks in each. `lists_of` gives
the ordered chunk digests of each distinct file; `references` finds by a join on digests which chunks
occur more than once, and which place keeps their bytes; `deduplicated` is the store, each chunk
once; `restore` fills the gaps by a join on digests, puts files together and checks them against
their digests. Only digests and shared chunks are dealt out by digest: all other bytes move once.
Files are named by digest, so however many rows hold the same payload it is stored and restored once.

Null text counts as empty; its payload is one block of blanks. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK = 192
RATE = 8000
LEAST, GREATEST, BITS, WINDOW = 512, 8192, 11, 32
LEVEL = 12
DICT_TEXTS, DICT_BYTES = 2_000, 112 << 10  #: texts at most that the compression dictionary is fitted on
STEP_BYTES = 4 << 20  #: bytes hashed at a time in a task

#: The gear table: the top halves of the squares of odd multiples of the golden ratio's fraction.
GEAR = (((np.arange(256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(2) >> np.uint64(32)).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file: PCM, one channel, 8 bits a sample."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file, found by walking its chunks."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    n = struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + n]


def cut_points(flat: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash allows a cut."""
    h = GEAR[flat]
    k = 1
    while k < WINDOW:  # doubles the number of bytes that each hash covers
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h, k = wider, 2 * k
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def split(files: list[bytes]) -> list[list[bytes]]:
    """Chunks of each file. The hashes run over all files at once: no cut lies within the first
    LEAST bytes of a file, so none depends on the file before."""
    flat = np.frombuffer(b"".join(files), np.uint8)
    points = cut_points(flat)
    out, base = [], 0
    for f in files:
        own, s = [], 0
        while len(f) - s > GREATEST or (len(f) - s > LEAST and s < len(f)):
            k = np.searchsorted(points, base + s + LEAST)
            e = min(int(points[k]) - base if k < len(points) else len(f), s + GREATEST, len(f))
            own.append(f[s:e])
            s = e
        if s < len(f):
            own.append(f[s:])
        out.append(own)
        base += len(f)
    return out


def feature(data: bytes) -> str:
    """Level, energy, crossings and peak of the samples, in integers."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};crossings={crossings};peak={int(np.abs(x).max())}"


def steps(batches, name: str):
    """Distinct stored files of a partition, some megabytes at a time."""
    held, size, seen = [], 0, set()
    for b in batches:
        for raw in b.column(name).cast(pa.binary()).to_pylist():
            media = wav(payload_of(raw or b""))
            digest = hashlib.sha256(media).digest()
            if digest in seen:
                continue
            seen.add(digest)
            held.append((digest, media))
            size += len(media)
            if size >= STEP_BYTES:
                yield held
                held, size = [], 0
        if len(seen) > 200_000:
            seen = set()
    if held:
        yield held


def media_digest(text: Column) -> Column:
    """SHA-256 of the stored form."""

    @F.arrow_udf("binary")
    def digest(col: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(wav(payload_of(x or b""))).digest() for x in col.cast(pa.binary()).to_pylist()], pa.binary())

    # Never null, so that a join needs no filter on it, which would run the function again.
    return F.coalesce(digest(text), F.lit(b""))


def fit_dictionary(df: DataFrame, text: str) -> bytes:
    """A zstd dictionary from at most DICT_TEXTS texts. It only affects the size of what is stored."""
    got = [r[0].encode() for r in df.where(F.length(text) > 64).select(F.substring(text, 1, 20_000)).limit(DICT_TEXTS).toLocalIterator()]
    if sum(map(len, got)) < 100 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, got).as_bytes()
    except zstandard.ZstdError:
        return b""


def forms_of(df: DataFrame, dictionary, text: str = "text") -> DataFrame:
    """Each distinct stored form: media (its digest), and data, its chunks in order (zstd)."""

    def run(batches):
        d = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        if d:
            d.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False)
        for held in steps(batches, text):
            parts = split([m for _, m in held])
            yield pa.record_batch([pa.array([d for d, _ in held], pa.binary()), pa.array([[press.compress(p) for p in own] for own in parts], pa.list_(pa.binary()))], ["media", "data"])

    # The filter is what joins infer: with it both uses of the forms have one plan, and share its exchange.
    return df.select(text).mapInArrow(run, "media binary, data array<binary>").where("media is not null").dropDuplicates(["media"])


def lists_of(df: DataFrame, text: str = "text") -> DataFrame:
    """The ordered chunk digests of each distinct stored form: media, digests."""

    def run(batches):
        for held in steps(batches, text):
            parts = split([m for _, m in held])
            yield pa.record_batch([pa.array([d for d, _ in held], pa.binary()), pa.array([[hashlib.sha256(p).digest() for p in own] for own in parts], pa.list_(pa.binary()))], ["media", "digests"])

    return df.select(text).mapInArrow(run, "media binary, digests array<binary>").dropDuplicates(["media"])


def references(lists: DataFrame) -> DataFrame:
    """For each stored form, the places of its chunks that occur more than once anywhere: at, digest,
    and whether this place is the one that keeps the bytes."""
    places = lists.select("media", F.posexplode("digests").alias("at", "digest"))
    shared = places.groupBy("digest").agg(F.min(F.struct("media", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    refs = places.join(shared, "digest").select("media", F.struct("at", "digest", (F.col("owner") == F.struct("media", "at")).alias("own")).alias("ref"))
    return refs.groupBy("media").agg(F.collect_list("ref").alias("refs"))


def deduplicated(forms: DataFrame, refs: DataFrame) -> DataFrame:
    """The store: media, refs and data, in which a chunk that another place keeps is null."""
    joined = forms.join(refs, "media", "left")
    elsewhere = F.transform(F.filter("refs", lambda r: ~r["own"]), lambda r: r["at"])
    bare = F.transform("data", lambda x, k: F.when(~F.array_contains(elsewhere, k), x))
    return joined.select("media", "refs", F.when(F.col("refs").isNull(), F.col("data")).otherwise(bare).alias("data"))


RESTORED = "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"


def restore(store: DataFrame, refs: DataFrame, dictionary) -> DataFrame:
    """Fills the gaps of each stored form by a join on digests, puts it together, checks it against
    its digest and reads it back."""

    def assemble(batches):
        d = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        unpress = zstandard.ZstdDecompressor(dict_data=d)
        for b in batches:
            out = []
            for name, data, borrowed in zip(*(b.column(c).to_pylist() for c in ("media", "data", "borrowed"))):
                for r in borrowed or ():
                    data[r["at"]] = r["data"]
                if any(x is None for x in data):
                    raise ValueError(f"stored media {name.hex()} lacks a chunk")
                media = b"".join(map(unpress.decompress, data))
                if hashlib.sha256(media).digest() != name:
                    raise ValueError(f"stored media {name.hex()} is damaged")
                own = samples(media)
                out.append((name, len(own), hashlib.sha256(own).digest(), zlib.crc32(own[-16:]), len(media), feature(own)))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    kept = store.where("refs is not null").select(F.explode(F.filter("refs", lambda r: r["own"])).alias("r"), "data").select("r.digest", F.get("data", F.col("r.at")).alias("data"))
    asked = refs.select("media", F.explode(F.filter("refs", lambda r: ~r["own"])).alias("r")).select("media", "r.*")
    borrowed = asked.join(kept, "digest").groupBy("media").agg(F.collect_list(F.struct("at", "data")).alias("borrowed"))
    return store.select("media", "data").join(borrowed, "media", "left").mapInArrow(assemble, RESTORED)


def store_and_read(df: DataFrame, text: str = "text", to: str = "media") -> tuple[DataFrame, DataFrame]:
    """df with the digest of its stored form in `to`, and what restoring each stored form gives."""
    sent = df.sparkSession.sparkContext.broadcast(fit_dictionary(df, text))
    refs = stored(references(lists_of(df, text)), "references")
    read = restore(deduplicated(forms_of(df, sent, text), refs), refs, sent)
    return df.withColumn(to, media_digest(F.col(text))), read
