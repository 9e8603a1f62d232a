"""Media columns: AVI files of motion-JPEG, written, read back and split into shots.

Method: a payload of bytes becomes the 8-bit samples of grey frames of 16 x 12. Each frame is an intra
coded JPEG of the lossless process (SOF3, predictor 1), so the samples come back exactly; frames are
``00dc`` chunks of a RIFF/AVI file with an ``idx1`` index. Reading parses the RIFF chunks, follows the
index to the frames and decodes each. Shots are found by adaptive histogram differences: the distance
of neighbouring frames' 16-bin histograms against the mean and deviation of the distances within the
clip. ``clips`` yields a timed row for each shot.

The Huffman table gives category s a code of 9 - s bits. With the s extra bits each difference takes
nine bits in all, a frame's scan is 216 bytes, and both directions run as array operations over all
frames of a batch. Readers follow the tables in the file: another table is refused, not misread.

Memory: Arrow batches are worked on in slices of about 4 MB of text. Rows are independent: one map,
no shuffle.

Nulls and edge cases: a null text is the empty text, stored as one frame of blanks; every text gets at
least one frame; a null doc_id is kept; equal texts give equal bytes; repeated rows and clashing columns
are passed by; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import by_bytes, documents, texts

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
FPS = 25
BINS = 16
DEVIATIONS = 2.0
LEAST_DISTANCE = 0.25

_SCAN = FRAME * 9 // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: one code of each length 1..9 for the categories 8..0
_TABLE = _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
_SIZE = _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
_START = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
_HEAD = b"\xff\xd8" + _SIZE + _TABLE + _START
_TAIL = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference -255..255 (at +255), and back."""
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code[d + 255] = ((1 << (9 - s)) - 2) << s | (d if d > 0 else d + (1 << s) - 1)
        back[code[d + 255]] = d
    return code, back


_CODE, _BACK = _codes()


def encode_scans(samples: np.ndarray) -> np.ndarray:
    """(frames, 192) samples to (frames, 216) bytes of entropy-coded differences, before byte stuffing."""
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    v = _CODE[d + 255].reshape(-1, FRAME // 8, 8)
    out = np.empty((len(x), FRAME // 8, 9), np.uint8)
    out[:, :, 0] = v[:, :, 0] >> 1
    for k in range(1, 8):
        out[:, :, k] = ((v[:, :, k - 1] << (8 - k)) & 0xFF) | (v[:, :, k] >> (k + 1))
    out[:, :, 8] = v[:, :, 7] & 0xFF
    return out.reshape(-1, _SCAN)


def decode_scans(scans: np.ndarray) -> np.ndarray:
    """The inverse of encode_scans."""
    b = scans.reshape(-1, FRAME // 8, 9).astype(np.uint16)
    v = np.empty((len(b), FRAME // 8, 8), np.uint16)
    for k in range(8):
        v[:, :, k] = ((b[:, :, k] & ((1 << (8 - k)) - 1)) << (k + 1)) | (b[:, :, k + 1] >> (7 - k))
    d = _BACK[v].reshape(-1, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """An AVI file of JPEG frames; the INFO list keeps the payload's length without padding."""
    movi, index, at = [b"movi"], [], 4
    for x in frames:
        movi.append(x if len(x) % 2 == 0 else x + b"\0")
        index.append((at, len(x)))
        at += 8 + len(movi[-1])
    n = len(frames)
    entries = np.empty((n, 4), "<u4")
    entries[:, 0], entries[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    entries[:, 2:] = index
    head = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_bytes).encode() + b"\0"))
    # each frame goes in under its own chunk header
    body = b"".join([movi[0], *(b"00dc" + struct.pack("<I", size) + x for (_, size), x in zip(index, movi[1:], strict=True))])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", body) + _chunk(b"idx1", entries.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """Frames in index order, the payload's length and the microseconds of a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = index = None
    n_bytes, micros = -1, 0
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif kind == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif kind == b"avih":
                micros = struct.unpack_from("<I", data, at + 8)[0]
            elif kind == b"ICMT":
                n_bytes = int(data[at + 8 : at + 8 + size].rstrip(b"\0"))
            elif kind == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    return [data[movi + o + 8 : movi + o + 8 + n] for o, n in index[:, 2:].tolist()], n_bytes, micros


def frame_scan(frame: bytes) -> bytes:
    """The unstuffed scan of one JPEG frame, after a walk over its segments."""
    if frame.startswith(_HEAD) and frame.endswith(_TAIL):
        at = len(_HEAD)
    else:
        at, seen = 2, {}
        while frame[at + 1] != 0xDA:
            n = struct.unpack_from(">H", frame, at + 2)[0]
            seen[frame[at + 1]] = frame[at : at + 2 + n]
            at += 2 + n
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if seen.get(0xC3) != _SIZE or seen.get(0xC4) != _TABLE or not frame.endswith(_TAIL):
            raise ValueError("a JPEG frame of another geometry or table")
    return frame[at:-2].replace(b"\xff\x00", b"\xff")


def encode(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, each padded to whole frames."""
    whole = [padded(p) for p in payloads]
    scans = encode_scans(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, FRAME))
    raw, at, out = scans.tobytes(), 0, []
    for p, w in zip(payloads, whole, strict=True):
        n = len(w) // FRAME
        out.append(write_avi([_HEAD + raw[i : i + _SCAN].replace(b"\xff", b"\xff\x00") + _TAIL for i in range(at, at + n * _SCAN, _SCAN)], len(p)))
        at += n * _SCAN
    return out


def decode(files: list[bytes]) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """All frames' samples, and per file the frames, the payload's length and the microseconds of a frame."""
    scans, counts, lengths, micros = [], [], [], []
    for data in files:
        frames, n, us = read_avi(data)
        scans += map(frame_scan, frames)
        counts.append(len(frames))
        lengths.append(n)
        micros.append(us)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    return decode_scans(raw.reshape(-1, _SCAN)), counts, lengths, micros


def shots(samples: np.ndarray, counts: list[int], deviations: float = DEVIATIONS, least: float = LEAST_DISTANCE) -> list[list[int]]:
    """Per file the first frames of its shots, 0 the first.

    A cut lies before a frame whose histogram distance to the frame before (0 to 1) is over ``least`` and
    over the mean of the file's distances by ``deviations`` times their deviation.
    """
    n = len(samples)
    hist = np.bincount((np.arange(n, dtype=np.int64)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    distance = np.zeros(n)
    distance[1:] = np.abs(hist[1:] - hist[:-1]).sum(1) / (2 * FRAME)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    distance[starts] = 0
    per = np.maximum(np.array(counts) - 1, 1)
    mean = np.add.reduceat(distance, starts) / per
    square = np.add.reduceat(distance * distance, starts) / per
    limit = np.maximum(mean + deviations * np.sqrt(np.maximum(square - mean * mean, 0)), least)
    cuts = np.flatnonzero(distance > np.repeat(limit, counts))
    out: list[list[int]] = [[0] for _ in counts]
    for cut, file in zip(cuts.tolist(), (np.searchsorted(starts, cuts, "right") - 1).tolist(), strict=True):
        out[file].append(cut - int(starts[file]))
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and the media column of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode([t.encode() for t in texts(batch)]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of each file: doc_id, clip, first_frame, frames, start_ms, end_ms. A null file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media"):
            kept = [(d, m) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None]
            rows = []
            if kept:
                samples, counts, _, micros = decode([m for _, m in kept])
                for (doc, _), n, us, first in zip(kept, counts, micros, shots(samples, counts), strict=True):
                    rows += [(doc, k, a, b - a, a * us // 1000, b * us // 1000) for k, (a, b) in enumerate(zip(first, [*first[1:], n], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "clip", "first_frame", "frames", "start_ms", "end_ms"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_ms long, end_ms long")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores and reads back every text; the feature lists the shots as first frame and milliseconds."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            files = encode([t.encode() for t in texts(batch)])
            samples, counts, lengths, micros = decode(files)
            raw, at, rows = samples.tobytes(), 0, []
            for doc, media, n, length, us, first in zip(batch.column(0).to_pylist(), files, counts, lengths, micros, shots(samples, counts), strict=True):
                payload = raw[at : at + n * FRAME]
                at += n * FRAME
                feature = f"frames={n};shots=" + ",".join(f"{a}@{a * us // 1000}" for a in first)
                rows.append((doc, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
