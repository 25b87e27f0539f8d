"""Media columns: ISO media containers, read by walking their boxes and decoding their sample tables, not their payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import table, written

UNIT = 64
#: The containers written here hold frames of 64 8-bit samples, in chunks of so many frames, the first of which is the key frame.
CHUNK_FRAMES, TIMESCALE = 64, 25
# Fixed values of the format: boxes that only hold other boxes.
NESTS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table_of(numbers, form: str = ">u4") -> bytes:
    a = np.asarray(numbers, dtype=form)
    return struct.pack(">I", len(a)) + a.tobytes()


FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def head_boxes(frames: int) -> dict[str, bytes]:
    """The boxes whose length is the same for any number of frames."""
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII", 8, 8, 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
    return {
        "mvhd": full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2)),
        "tkhd": full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), UNITY, struct.pack(">II", 8 << 16, 8 << 16), flags=3),
        "mdhd": full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
        "hdlr": full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
        "vmhd": full_box(b"vmhd", bytes(8), flags=1),
        "dinf": box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))),
        "stsd": full_box(b"stsd", struct.pack(">I", 1), entry),
        "stts": full_box(b"stts", struct.pack(">III", 1, frames, 1)),
        "stsz": full_box(b"stsz", struct.pack(">II", UNIT, frames)),
    }


def container(payload: bytes) -> bytes:
    """Payload bytes as the frames of one raw 8 x 8 grey track. The length has to be a positive multiple of 64."""
    frames = len(payload) // UNIT
    if not frames or frames * UNIT != len(payload):
        raise ValueError("the payload is no positive multiple of 64 bytes")
    if len(payload) + 8 >= 1 << 32:
        raise ValueError("a payload of 4 GiB or more needs another layout")
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    per_chunk = [(1, CHUNK_FRAMES, 1)] if chunks > 1 else []
    if last != CHUNK_FRAMES or chunks == 1:
        per_chunk.append((chunks, last, 1))
    start = len(FTYP) + 8
    where = start + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * UNIT
    runs = struct.pack(">I", len(per_chunk)) + b"".join(struct.pack(">III", *r) for r in per_chunk)
    h = head_boxes(frames)
    places = full_box(b"co64", table_of(where, ">u8")) if start + len(payload) >= 1 << 32 else full_box(b"stco", table_of(where))
    stbl = box(b"stbl", h["stsd"], h["stts"], full_box(b"stss", table_of(1 + np.arange(chunks) * CHUNK_FRAMES)), full_box(b"stsc", runs), h["stsz"], places)
    minf = box(b"minf", h["vmhd"], h["dinf"], stbl)
    moov = box(b"moov", h["mvhd"], box(b"trak", h["tkhd"], box(b"mdia", h["mdhd"], h["hdlr"], minf)))
    return FTYP + box(b"mdat", payload) + moov


def boxes(data, at: int, end: int):
    """kind, start and end of the body of each box, in order; a box that runs past its parent raises ValueError."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} is cut off")
        yield kind, body, stop
        at = stop


def leaves(data, at: int, end: int, found: dict, tracks: list) -> None:
    for kind, a, b in boxes(data, at, end):
        if kind == b"trak":
            tracks.append({})
            leaves(data, a, b, tracks[-1], tracks)
        elif kind in NESTS:
            leaves(data, a, b, found, tracks)
        else:
            found.setdefault(kind, (a, b))


def numbers(data, at: int, form: str, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype=form, count=count, offset=at).astype(np.int64)


def samples(data, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample, from the chunk, run and size tables."""
    a, _ = track[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    sizes = np.full(n, fixed, dtype=np.int64) if fixed else numbers(data, a + 12, ">u4", n)
    wide = b"co64" in track
    a, _ = track[b"co64" if wide else b"stco"]
    (chunks,) = struct.unpack_from(">I", data, a + 4)
    where = numbers(data, a + 8, ">u8" if wide else ">u4", chunks)
    a, _ = track[b"stsc"]
    (runs,) = struct.unpack_from(">I", data, a + 4)
    run = numbers(data, a + 8, ">u4", 3 * runs).reshape(-1, 3)
    per_chunk = np.repeat(run[:, 1], np.diff(np.append(run[:, 0], chunks + 1)))
    first = np.cumsum(per_chunk) - per_chunk
    upto = np.cumsum(sizes) - sizes
    chunk_of = np.repeat(np.arange(chunks), per_chunk)[:n]
    return where[chunk_of] + upto - upto[first][chunk_of], sizes


def described(data: bytes) -> dict:
    """codec, duration in seconds, and the byte ranges of the key frames of the first track with samples."""
    tracks: list[dict] = []
    leaves(data, 0, len(data), {}, tracks)
    for track in tracks:
        if b"stsz" in track and b"stsd" in track:
            break
    else:
        raise ValueError("no track has samples")
    offsets, sizes = samples(data, track)
    a, _ = track[b"stsd"]
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    a, _ = track[b"mdhd"]
    scale, length = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
    a, _ = track[b"stts"]
    (entries,) = struct.unpack_from(">I", data, a + 4)
    times = numbers(data, a + 8, ">u4", 2 * entries).reshape(-1, 2)
    ticks = int((times[:, 0] * times[:, 1]).sum()) or length
    if b"stss" in track:
        a, _ = track[b"stss"]
        (keys,) = struct.unpack_from(">I", data, a + 4)
        key = numbers(data, a + 8, ">u4", keys) - 1
    else:
        key = np.arange(len(sizes))
    return {"codec": codec, "duration": ticks / max(1, scale), "samples": len(sizes), "keys": list(zip(offsets[key].tolist(), (offsets[key] + sizes[key]).tolist())), "offsets": offsets, "sizes": sizes}


def payload_of(data: bytes, found: dict) -> bytes:
    """The samples' bytes, one after the other; neighbouring samples are copied at once."""
    o, s = found["offsets"], found["sizes"]
    breaks = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(o)])) - 1
    return b"".join(data[a:b] for a, b in zip(o[first].tolist(), (o[last] + s[last]).tolist()))


def media_of_text(text: Column) -> Column:
    """A container of the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64; null is empty."""
    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = t.encode() if t else b""
            out.append(container(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
        return pd.Series(out, dtype=object)

    return stored(text)


def media_columns(media: Column) -> Column:
    """Struct of codec, duration, samples and key-frame ranges of a binary column; null where the bytes are null or no such container."""
    @F.pandas_udf("codec string, duration double, samples long, keyframes array<struct<first: long, end: long>>")
    def read(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for data in stored:
            try:
                d = described(data)
                rows.append((d["codec"], d["duration"], d["samples"], [{"first": a, "end": b} for a, b in d["keys"]]))
            except (ValueError, KeyError, struct.error, IndexError, TypeError):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["codec", "duration", "samples", "keyframes"])

    return read(media)


def read_back(media: Column) -> Column:
    """Of containers made here: size, digests, checksum of the end, and the feature string of the bytes read back, with what the sample tables say."""
    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, n_keyframes long")
    def read(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for data in stored:
            d = described(data)
            payload = payload_of(data, d)
            keys = ",".join(f"{a}-{b}" for a, b in d["keys"])
            feature = f"codec={d['codec'].strip()};duration={d['duration']:.2f};samples={d['samples']};keyframes={keys}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, d["codec"], d["duration"], len(d["keys"])))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes"])

    return read(media)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a stored media column. Null and empty texts give 64 zero bytes; equal texts give equal values;
    repeated rows stay; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = written(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media_of_text(F.col("text")).alias("media")), "media")
    return stored.select("doc_id", "n_bytes", read_back(F.col("media")).alias("back")).select("doc_id", "n_bytes", "back.*")


def oracle() -> str:
    """The query as SQL: containers put together as hexadecimal digits, a nest a step, from boxes of fixed length with a number of frames that is replaced."""
    sign = 0x1ABCDEF1
    fixed = {k: f"replace('{b.hex()}', '{sign:08x}', printf('%08x', frames))" for k, b in head_boxes(sign).items()}
    word = lambda x: f"printf('%08x', {x})"
    boxed = lambda kind, body: f"concat({word(f'8 + length({body}) // 2')}, '{kind.encode().hex()}', {body})"
    each = lambda x: f"array_to_string(list_transform(range(0, chunks), lambda i: {x}), '')"
    chunk, start = CHUNK_FRAMES * UNIT, len(FTYP) + 8
    many = lambda kind, x: f"concat({word('16 + 4 * chunks')}, '{kind.encode().hex()}', '00000000', {word('chunks')}, {each(word(x))})"
    one, rest = f"concat({word(1)}, {word(CHUNK_FRAMES)}, {word(1)})", f"concat({word('chunks')}, {word('frames - (chunks - 1) * ' + str(CHUNK_FRAMES))}, {word(1)})"
    runs = f"concat(CASE WHEN chunks > 1 THEN {one} ELSE '' END, CASE WHEN chunks = 1 OR frames % {CHUNK_FRAMES} > 0 THEN {rest} ELSE '' END)"
    steps = f"flatten(list_transform(range(1, {UNIT} + 1), lambda i: [CAST(concat('0x', substr(pay, length(pay) - {2 * UNIT} + 2 * i - 1, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    keys = "array_to_string(list_transform(range(0, chunks), lambda i: concat(" + f"{start} + i * {chunk}, '-', {start + UNIT} + i * {chunk})), ',')"
    return f"""WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, n, concat(h, repeat('00', greatest({UNIT}, (n + {UNIT - 1}) // {UNIT} * {UNIT}) - n)) AS pay FROM t),
f AS (SELECT *, length(pay) // {2 * UNIT} AS frames, (length(pay) // {2 * UNIT} + {CHUNK_FRAMES - 1}) // {CHUNK_FRAMES} AS chunks FROM p),
a AS (SELECT *, {runs} AS runs FROM f),
b AS (SELECT *, concat({fixed['stsd']}, {fixed['stts']}, {many('stss', f'1 + i * {CHUNK_FRAMES}')}, {word('16 + length(runs) // 2')}, '{b'stsc'.hex()}', '00000000', {word('length(runs) // 24')}, runs, {fixed['stsz']}, {many('stco', f'{start} + i * {chunk}')}) AS body FROM a),
c AS (SELECT * REPLACE (concat({fixed['vmhd']}, {fixed['dinf']}, {boxed('stbl', 'body')}) AS body) FROM b),
d AS (SELECT * REPLACE (concat({fixed['mdhd']}, {fixed['hdlr']}, {boxed('minf', 'body')}) AS body) FROM c),
e AS (SELECT * REPLACE (concat({fixed['tkhd']}, {boxed('mdia', 'body')}) AS body) FROM d),
g AS (SELECT * REPLACE (concat({fixed['mvhd']}, {boxed('trak', 'body')}) AS body) FROM e),
m AS (SELECT *, concat('{FTYP.hex()}', {boxed('mdat', 'pay')}, {boxed('moov', 'body')}) AS media FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(length(pay) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(pay)) AS payload_sha256, xor({crc}, 4294967295) AS tail_crc32, CAST(length(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
concat('codec=raw;duration=', printf('%.2f', frames / {float(TIMESCALE)}), ';samples=', frames, ';keyframes=', {keys}) AS feature, 'raw ' AS codec, CAST(frames AS DOUBLE) / {TIMESCALE} AS duration, CAST(chunks AS BIGINT) AS n_keyframes FROM m"""


ORACLE_SQL = oracle()
