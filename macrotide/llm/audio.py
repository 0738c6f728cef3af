"""Telephony audio columns: mu-law and A-law, IMA ADPCM blocks, and resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import table, written

RATE, PCM_RATE, BLOCK = 8000, 16000, 64
#: WAVE format tags: A-law, mu-law, IMA ADPCM.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: IMA ADPCM: how the step index moves with a code's magnitude (fixed values of the format).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA ADPCM step sizes (fixed values of the format).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
#: Blocks decoded at a time.
BLOCKS_AT_ONCE = 4096
#: Payload bytes of one codec that are decoded before their rows are handed on.
BYTES_AT_ONCE = 1 << 21


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte."""
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7).astype(np.int32)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def expand(codes: np.ndarray, law: str) -> np.ndarray:
    return TABLES[law][codes]


def _ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and code (16 * index + code): the change of the sample, and the next index."""
    index, code = np.divmod(np.arange(89 * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32), np.clip(index + INDEX_MOVES[code & 7], 0, 88).astype(np.int32)


_CHANGE, _NEXT = _ima_moves()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM (n, 1 + 2 * (width - 4)) of mono blocks (n, width): every step runs across all blocks.

    Each block starts with its first sample (little-endian), its step index (held to 0..88) and
    a spare byte; then two codes a byte, the low one first.
    """
    blocks = np.ascontiguousarray(blocks)
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = sample
    body = blocks[:, 4:].T
    codes = np.empty((2 * (width - 4), n), np.int32)
    codes[0::2], codes[1::2] = body & 15, body >> 4
    for i, code in enumerate(codes):
        at = (index << 4) + code
        sample = np.clip(sample + _CHANGE[at], -32768, 32767)
        index = _NEXT[at]
        out[i + 1] = sample
    return out.T


def wave(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAVE file that holds ``payload`` as it is: 8-bit samples of mu-law or A-law, or ADPCM blocks of BLOCK bytes."""
    if codec == "ima_adpcm":
        per_block = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        fact = per_block * (len(payload) // BLOCK)
    else:
        fmt, fact = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    odd = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, fact) + b"data" + struct.pack("<I", len(payload)) + payload + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), "")
        elif kind == b"data":
            if not codec:
                raise ValueError("no telephony format")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate, linear between samples, the last one held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.round(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def decode(media: bytes, to: int = PCM_RATE) -> np.ndarray:
    """Resampled PCM of a WAVE file of any of the three codecs."""
    codec, rate, payload = read_wave(media)
    codes = np.frombuffer(payload, np.uint8)
    if codec == "ima_adpcm":
        blocks = codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)
        pcm = np.concatenate([decode_ima(blocks[i : i + BLOCKS_AT_ONCE]).ravel() for i in range(0, len(blocks), BLOCKS_AT_ONCE)] or [np.zeros(0, np.int16)])
    else:
        pcm = expand(codes, codec)
    return resample(pcm, rate, to)


def features(pcm: np.ndarray) -> str:
    """Samples, RMS, peak and zero crossings, from exact integer sums."""
    below = pcm < 0
    power = 0
    for at in range(0, len(pcm), 1 << 20):  # so few squares add up exactly
        part = pcm[at : at + (1 << 20)].astype(np.float64)
        power += int(part @ part)
    peak = max(int(pcm.max(initial=0)), -int(pcm.min(initial=0)))
    return f"n={len(pcm)};rms={(power / max(1, len(pcm))) ** 0.5:.3f};peak={peak};zc={int(np.count_nonzero(below[1:] != below[:-1]))}"


def padded(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of BLOCK."""
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def store_audio(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's bytes, padded, as a WAVE file of ``codec``.

    A null text is empty and gives one block of zeros. Repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.encode() for x in pc.fill_null(batch.column(1), "").to_pylist()]
            media = pa.array([wave(padded(x), codec) for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, rows), pa.int64()), media], ["id", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, n_bytes long, media binary")


def describe_audio(media: DataFrame, to: int = PCM_RATE, keep_pcm: bool = True) -> DataFrame:
    """Adds pcm (16-bit little-endian, resampled), and digests and features of the stored bytes, to (id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, tails = [], np.zeros((len(batch), BLOCK), np.uint8)
            for i, stored in enumerate(batch.column(2).to_pylist()):
                _, _, payload = read_wave(stored)
                pcm = decode(stored, to)
                tails[i, : len(payload[-BLOCK:])] = np.frombuffer(payload[-BLOCK:], np.uint8)
                out.append((pcm.astype("<i2").tobytes() if keep_pcm else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(pcm)))
            out = [(*x, features(tail)) for x, tail in zip(out, decode_ima(tails))]
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n_bytes", "pcm", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "adpcm_tail_feature"])

    return media.mapInArrow(run, "id long, n_bytes long, pcm binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, adpcm_tail_feature string")


def store_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's bytes, padded, as WAVE files of all codecs in the order of TAGS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.encode() for x in pc.fill_null(batch.column(1), "").to_pylist()]
            for part in _parts([len(x) for x in rows]):
                media = pa.array([[wave(padded(x), codec) for codec in TAGS] for x in rows[part]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([len(x) for x in rows[part]], pa.int64()), media], ["id", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, n_bytes long, media array<binary>")


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Slices of rows of about BYTES_AT_ONCE each, one row at least."""
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > BYTES_AT_ONCE:
            yield slice(at, i)
            at = i
            held = 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def describe_all(media: DataFrame, to: int = PCM_RATE, keep_pcm: bool = True) -> DataFrame:
    """(id, n_bytes, pcm, features and digests) from ``store_all``: every stored block of every codec is decoded and resampled.

    pcm holds 16-bit little-endian samples in the order of TAGS (null unless it is kept),
    feature_<codec> their features and pcm_sha256_<codec> their digests.
    payload_sha256, tail_crc32, media_bytes and media_sha256 are of the mu-law file, and
    adpcm_tail_feature is of the last ADPCM block, not resampled. Raises if a row's payloads differ.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "adpcm_tail_feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    by_codec = [f"{what}_{c}" for what in ("feature", "pcm_sha256") for c in TAGS]
    mulaw = list(TAGS).index("mulaw")

    def described(stored: list[list[bytes]]) -> tuple[list, list, list, list]:
        read = [[read_wave(m) for m in row] for row in stored]
        payloads = [row[mulaw][2] for row in read]
        if any(payload != p for row, p in zip(read, payloads) for _, _, payload in row):
            raise ValueError("payloads of a row differ")
        # ADPCM blocks of all rows are decoded together: a short row alone would cost as many steps as a long one.
        ima = next(i for i, c in enumerate(TAGS) if c == "ima_adpcm")
        blocks = np.frombuffer(b"".join(row[ima][2] for row in read), np.uint8).reshape(-1, BLOCK)
        decoded = np.concatenate([decode_ima(blocks[i : i + BLOCKS_AT_ONCE]) for i in range(0, len(blocks), BLOCKS_AT_ONCE)])
        ends = np.cumsum([len(p) // BLOCK for p in payloads])
        pcm, found, digests, rows = [], [], [], []
        for m, row, payload, end in zip(stored, read, payloads, ends):
            sound = []
            for codec, rate, raw in row:
                samples = decoded[end - len(raw) // BLOCK : end].ravel() if codec == "ima_adpcm" else expand(np.frombuffer(raw, np.uint8), codec)
                sound.append(resample(samples, rate, to))
            raw_pcm = [np.ascontiguousarray(x, "<i2") for x in sound]
            pcm.append([x.tobytes() for x in raw_pcm] if keep_pcm else None)
            digests.append([hashlib.sha256(x).hexdigest() for x in raw_pcm])
            found.append([features(x) for x in sound])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m[mulaw]), hashlib.sha256(m[mulaw]).hexdigest(), features(decoded[end - 1])))
        return pcm, found, digests, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.column(1).to_pylist()):
                pcm, found, digests, rows = described(batch.column(2)[part].to_pylist())
                columns = [pa.array(pcm, pa.list_(pa.binary())), *[pa.array(x, pa.string()) for x in (*zip(*found), *zip(*digests))], *[pa.array(x, t) for x, t in zip(zip(*rows), types)]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *columns], ["id", "n_bytes", "pcm", *by_codec, *names])

    kinds = ["long", "string", "long", "long", "string", "string"]
    return media.mapInArrow(run, "id long, n_bytes long, pcm array<binary>, " + ", ".join([f"{c} string" for c in by_codec] + [f"{n} {k}" for n, k in zip(names, kinds)]))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as mu-law, A-law and ADPCM media, stored and read back; all of it is decoded and resampled.

    Resampled PCM is 2.1 (mu-law, A-law) to 2.8 times (ADPCM) the size of the documents' Parquet
    files, compressed; here it is kept as its digests, and as samples by ``describe_all``.
    """
    stored = written(store_all(table(spark, sf_dir, "documents")), "audio-media")
    out = describe_all(stored, keep_pcm=False)
    same = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    short = {"alaw": "alaw", "mulaw": "mulaw", "ima_adpcm": "adpcm"}
    others = [F.col(f"feature_{c}").alias(f"{short[c]}_feature") for c in TAGS if c != "mulaw"]
    return out.select(F.col("id").alias("doc_id"), *same, F.col("feature_mulaw").alias("feature"), "adpcm_tail_feature", *others, *[F.col(f"pcm_sha256_{c}").alias(f"{short[c]}_pcm_sha256") for c in TAGS])
