"""GIF media columns: frames of timed samples with colour histograms, stored losslessly.

The writer stores bytes as palette indices; the reader takes any GIF: it decodes the LZW code streams, applies global
and local palettes, interlacing, transparency and disposal, and gives one row for each timed frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_rows

WIDTH = 192
#: Rows of samples in a frame that the writer makes.
FRAME_ROWS = 512
DELAY_CS = 4
#: A colour histogram has two bits for each of red, green and blue.
BINS = 64


def _palette() -> np.ndarray:
    k = np.arange(256)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 85], 1).astype(np.uint8)


PALETTE = _palette()


def _widths(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, and the bits before it."""
    first = (1 << least - 1) + 1  # the last code in use before any is learnt
    w = np.array([max(least, min(12, (first + k).bit_length())) for k in range(4200)], np.int64)
    return w, np.concatenate([[0], np.cumsum(w)])


_known_widths = {least: _widths(least) for least in range(3, 10)}


def lzw_encode(data: bytes) -> bytes:
    """Codes of eight-bit samples: a clear code first and whenever the table is full, an end code last."""
    runs, codes, table, fresh = [[256]], [], {}, 258
    known = table.get
    it = iter(data)
    p = next(it, None)
    if p is not None:
        for b in it:
            k = p << 8 | b
            c = known(k)
            if c is not None:
                p = c
                continue
            codes.append(p)
            if fresh < 4096:
                table[k] = fresh
                fresh += 1
            else:
                codes.append(256)
                runs.append(codes)
                codes, table, fresh = [], {}, 258
                known = table.get
            p = b
        codes.append(p)
    codes.append(257)
    runs.append(codes)
    w, _ = _known_widths[9]
    width = np.concatenate([w[: len(r)] for r in runs])
    end = np.cumsum(width)
    at = end - width
    value = np.concatenate([np.array(r, np.int64) for r in runs]) << (at & 7)
    byte, size = at >> 3, int(end[-1] + 7 >> 3)
    out = sum(np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least: int, size: int) -> bytes:
    """The first `size` samples; what a truncated stream lacks is filled with zeros. least: bits of a sample, plus one."""
    w, before = _known_widths[least]
    clear, end = 1 << least - 1, (1 << least - 1) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, place, out, got, done = 8 * len(data), 0, [], 0, False  # got: no more than what is out
    singles = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, prev = list(singles), None
    held = 0  # codes since the last clear code
    while not done and got < size:
        at = place + before[held : len(w)] - before[held]
        at = at[at + w[held : held + len(at)] <= bits]
        if not len(at):
            break
        width = w[held : held + len(at)]
        i = at >> 3
        codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (at & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        run = codes[:n].tolist()
        if prev is None and run:
            prev = table[run[0]] if run[0] < len(table) else b""
            out.append(prev)
            got += len(prev)
            run = run[1:]
        learn = 4096 - len(table)
        for c in run[:learn]:
            try:
                entry = table[c]
            except IndexError:
                entry = prev + prev[:1]  # the entry that this code is about to make
            table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
        for c in run[learn:]:
            prev = table[c]
            out.append(prev)
        got = sum(map(len, out))
        if len(stop):
            done |= bool(codes[n] == end)
            place = int(at[n] + width[n])
            table, prev, held = list(singles), None, 0
        else:  # longer without a clear code than the table of widths
            place = int(at[-1] + width[-1])
            held = min(held + len(at), len(w) - 300)
    return b"".join(out)[:size].ljust(size, b"\0")


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A GIF whose palette indices, frame by frame, are the payload (a positive multiple of width)."""
    step = width * FRAME_ROWS
    rows = min(FRAME_ROWS, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, rows, 0xF7, 0, 0), PALETTE.tobytes()]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        codes = lzw_encode(part)
        out += [bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)] + [b"\0"]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # palette indices, rows x columns
    canvas: np.ndarray  # what is shown: rows x columns, red | green << 8 | blue << 16 | 255 << 24, or 0 where nothing is
    delay_cs: int
    disposal: int
    transparent: int | None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, each with the canvas as it is shown. Raises ValueError if it is no GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def table(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        n = 3 * (2 << (flags & 7)) if flags & 0x80 else 0
        return (np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3) if n else None), at + n

    shared, at = table(flags, at)
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0], body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            at = after
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = table(flags, at + 10)
            colours = own if own is not None else shared if shared is not None else PALETTE
            least, at = data[at] + 1, at + 1
            body, at = _blocks(data, at)
            samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                lines = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[lines] = samples
                samples = straight
            saved = canvas.copy() if disposal == 3 else None
            region = canvas[top : top + h, left : left + w]
            shown = samples[: region.shape[0], : region.shape[1]]
            solid = colours.astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16], np.uint32) | np.uint32(255 << 24)
            drawn = solid[shown] if len(solid) == 256 else solid[np.minimum(shown, len(solid) - 1)]
            region[...] = drawn if transparent is None else np.where(shown == transparent, region, drawn)
            yield Frame(left, top, samples, canvas.copy(), delay, disposal, transparent)
            if disposal == 2:
                region[...] = 0
            elif saved is not None:
                canvas = saved
            delay, disposal, transparent = 0, 0, None
        else:
            break


def histogram(canvas: np.ndarray) -> list[int]:
    """Shown pixels by colour; those that nothing has been drawn on don't count."""
    p = canvas.ravel()
    p = p[p > 0] if p.size and p.min() == 0 else p
    return np.bincount((p >> 2 & 48 | p >> 12 & 12 | p >> 22 & 3).astype(np.int64), minlength=BINS).tolist()


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, they with spaces up to a positive multiple of WIDTH)."""
    raw = text.encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a GIF of the text's payload), written to the shared folder.

    Null texts are empty ones and become one row of spaces; repeated rows and null ids are kept; an empty table gives
    no rows; other columns are not read.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                payloads = [payload_of(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in payloads], "media": [encode(p) for _, p in payloads]})

    return materialize(text_rows(df, id_col, text_col).mapInPandas(task, "doc_id long, n_bytes long, media binary"), "gif")


FRAMES = "doc_id long, frame int, delay_ms int, left int, top int, width int, height int, disposal int, samples binary, histogram array<long>"


def frames(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each timed frame of each GIF. What is null or no GIF has no frames."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FRAMES.split(", ")]
        for pdf in batches:
            rows = []
            for d, media in zip(pdf["doc_id"].astype("Int64"), pdf["media"], strict=True):
                try:
                    for k, f in enumerate(decode(media or b"")):
                        rows.append((d, k, 10 * f.delay_cs, f.left, f.top, f.samples.shape[1], f.samples.shape[0], f.disposal, f.samples.tobytes(), histogram(f.canvas)))
                except (ValueError, struct.error, IndexError):
                    continue
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(task, FRAMES)


STORED_FRAMES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames array<struct<delay_ms int, left int, top int, width int, height int, disposal int, transparent int, histogram array<int>>>"
)


def store_frames(stored: DataFrame) -> DataFrame:
    """The stored GIFs read back and decoded: of each, its digests and its timed frames with their colour histograms.

    The feature is the number of frames and their summed histogram in thousandths. Written to the shared folder beside
    the media, which hold the frames' samples. stored: doc_id, n_bytes, media.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STORED_FRAMES.split(", ")[:8]] + ["frames"]
        for pdf in batches:
            rows = []
            for d, n, media in zip(pdf["doc_id"].astype("Int64"), pdf["n_bytes"], pdf["media"], strict=True):
                parts, timed, total = [], [], np.zeros(BINS, np.int64)
                for f in decode(media):
                    parts.append(f.samples.tobytes())
                    shown = histogram(f.canvas)
                    total += shown
                    timed.append({"delay_ms": 10 * f.delay_cs, "left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "disposal": f.disposal, "transparent": f.transparent, "histogram": shown})
                shares = 1000 * total // max(1, total.sum())
                feature = f"{len(parts)}:" + ",".join(map(str, shares))
                payload = b"".join(parts)
                rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, timed))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return materialize(stored.select("doc_id", "n_bytes", "media").mapInPandas(task, STORED_FRAMES), "gif-frames")
