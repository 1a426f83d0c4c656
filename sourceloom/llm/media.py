"""Media columns: types found by signatures, checked by structure.

An Aho-Corasick automaton over all magic bytes runs once over a value. At every hit the format's validator
walks the structure (chunks, blocks, boxes, declared sizes) and gives the length of the file there, or
nothing. A valid file at the start fixes the value's type, whatever was declared; others are embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

#: Unit to which payloads are filled up with bytes 255.
UNIT = 576
RATE = 8000


def _png(data: bytes, at: int, known: dict) -> int | None:
    """Chunks from IHDR to IEND, with right checksums."""
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        stop = place + 12 + size
        if stop > len(data) or first != (kind == b"IHDR") or first and size != 13:
            return None
        if zlib.crc32(data[place + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return stop - at
        place, first = stop, False
    return None


def _gif(data: bytes, at: int, known: dict) -> int | None:
    """Blocks up to the trailer.

    known has, for places of blocks (and, negated, of sub-blocks) that were walked, where that walk ended (0: nowhere), so that heads
    inside one another take linear time together.
    """
    if at + 13 > len(data):
        return None
    flags, place = data[at + 10], at + 13
    place += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def sub_blocks(place: int) -> int:
        passed = []
        while place < len(data) and data[place] and -place not in known:
            passed.append(-place)
            place += 1 + data[place]
        stop = known.get(-place, place + 1)
        known.update(dict.fromkeys(passed, stop))
        return stop

    passed, stop = [], 0
    while place < len(data):
        if place in known:
            stop = known[place]
            break
        passed.append(place)
        mark = data[place]
        if mark == 0x3B:
            stop = place + 1
            break
        if mark == 0x21:
            place = sub_blocks(place + 2)
        elif mark == 0x2C and place + 10 <= len(data):
            own = data[place + 9]
            place = sub_blocks(place + 10 + (3 << (own & 7) + 1 if own & 0x80 else 0) + 1)
        else:
            break
    known.update(dict.fromkeys(passed, stop))
    return stop - at if stop else None


def _jpeg(data: bytes, at: int, known: dict) -> int | None:
    """Segments up to the start of a scan, then up to the end marker."""
    place = at + 2
    while place + 2 <= len(data) and data[place] == 0xFF:
        mark = data[place + 1]
        if mark == 0xD9:
            return place + 2 - at
        if place + 4 > len(data):
            return None
        if mark == 0xFF:
            place += 1
            continue
        size = struct.unpack_from(">H", data, place + 2)[0]
        if size < 2 or not (0xC0 <= mark <= 0xFE) or 0xD0 <= mark <= 0xD8:
            return None
        place += 2 + size
        if mark == 0xDA:
            while True:  # entropy-coded data; 0xFF is followed by 0 or a restart mark there
                place = data.find(b"\xff", place)
                if place < 0 or place + 1 >= len(data):
                    return None
                if data[place + 1] == 0 or 0xD0 <= data[place + 1] <= 0xD7:
                    place += 2
                    continue
                break
    return None


def _riff(data: bytes, at: int, known: dict) -> int | None:
    """Chunks that fill the declared size exactly."""
    if at + 12 > len(data):
        return None
    stop = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if stop > len(data):
        return None
    place = at + 12
    while place + 8 <= stop:
        size = struct.unpack_from("<I", data, place + 4)[0]
        place += 8 + size + size % 2
    return stop - at if place == stop else None


def _bmp(data: bytes, at: int, known: dict) -> int | None:
    if at + 26 > len(data):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    fits = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size
    return size if fits and at + size <= len(data) else None


def _ogg(data: bytes, at: int, known: dict) -> int | None:
    """Pages in a row until all streams (by serial number) that began have ended; streams that begin right after belong to the file.

    All starts in a row of pages are decided when the row's first one is met, and known keeps where each file ends (0: nowhere).
    """
    if at not in known:
        known.update(_ogg_row(data, at))
    return known[at] - at if known[at] else None


def _ogg_row(data: bytes, at: int) -> dict[int, int]:
    """The end of the file that starts at each page of a row of pages.

    After page t the streams of a file that starts at page j have all ended if no stream's latest page up to t, from j on, leaves it
    open: if the last page that does is before j. The file ends at the first such t whose next page begins no stream, else at the last such t.
    """
    starts, ends, begins, last_open = [], [], [], []  # last_open: the latest page so far that leaves its stream open
    latest: dict[bytes, int] = {}
    serials: dict[int, bytes] = {}
    open_pages: list[int] = []  # rising; pages that are no longer open are dropped from the end
    place = at
    while data[place : place + 4] == b"OggS" and place + 27 <= len(data) and not data[place + 4]:
        n, flags, serial = data[place + 26], data[place + 5], data[place + 14 : place + 18]
        table = data[place + 27 : place + 27 + n]
        stop = place + 27 + n + sum(table)
        if len(table) < n or stop > len(data):
            break
        k = len(starts)
        starts.append(place)
        ends.append(stop)
        begins.append(bool(flags & 2))
        latest[serial] = -1 if flags & 4 else k
        if not flags & 4:
            open_pages.append(k)
            serials[k] = serial
        while open_pages and latest[serials[open_pages[-1]]] != open_pages[-1]:
            del serials[open_pages.pop()]
        last_open.append(open_pages[-1] if open_pages else -1)
        place = stop
    found = dict.fromkeys([*starts, at], 0)
    waiting: list[int] = []
    for t in range(len(starts)):
        waiting.append(t)
        if t + 1 == len(starts) or not begins[t + 1]:
            while waiting and waiting[-1] > last_open[t]:
                found[starts[waiting.pop()]] = ends[t]
    for t in range(len(starts) - 1, -1, -1):  # what never met such an end takes the last one there was
        low, high = bisect_right(waiting, last_open[t]), bisect_right(waiting, t)
        for j in waiting[low:high]:
            found[starts[j]] = ends[t]
        del waiting[low:high]
    return found


#: Types of boxes that stand at the top of a file.
BOXES = frozenset(b"ftyp moov mdat free skip wide meta moof mfra sidx ssix styp uuid pdin prft emsg udta".split())


def _mp4(data: bytes, at: int, known: dict) -> int | None:
    """Boxes from ftyp on, of known types, with 32-bit, 64-bit or open-ended sizes; none may be cut off. The magic stands four bytes in."""
    at, place, n = at - 4, at - 4, 0
    while at >= 0 and place + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        if kind not in BOXES or (n == 0) != (kind == b"ftyp"):
            break
        least = 8
        if size == 1:
            if place + 16 > len(data):
                return None
            size, least = struct.unpack_from(">Q", data, place + 8)[0], 16
        elif size == 0:
            size = len(data) - place
        if size < least or place + size > len(data):
            return None
        place, n = place + size, n + 1
    return place - at if n >= 2 else None


#: Magic bytes, type, validator and the magic's distance from the start of the file.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"RIFF", "riff", _riff, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"OggS", "application/ogg", _ogg, 0),
    (b"ftyp", "video/mp4", _mp4, 4),
)
#: Types of RIFF files by their form.
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Offset, length and type of the valid files in a value, in order; what lies inside one of them is kept too."""
    found, known = [], [{} for _ in FORMATS]
    for end, k in _automaton().iter(data.decode("latin-1")):
        magic, kind, validate, back = FORMATS[k]
        at = end - len(magic) + 1
        length = validate(data, at, known[k])
        if length:
            if kind == "riff":
                kind = RIFF_TYPES.get(data[at + 8 : at + 12], "application/riff")
            found.append((at - back, length, kind))
    return sorted(set(found))


def to_wav(payload: bytes) -> bytes:
    """Bytes as 8-bit samples of a mono PCM file."""
    form = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(data: bytes) -> bytes | None:
    """The samples of an 8-bit PCM file, None if it is none."""
    place, plain = 12, False
    while place + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, place)
        if kind == b"fmt ":
            plain = struct.unpack_from("<H", data, place + 8)[0] == 1 and struct.unpack_from("<H", data, place + 22)[0] == 8
        elif kind == b"data":
            return data[place + 8 : place + 8 + size] if plain else None
        place += 8 + size + size % 2
    return None


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared (a media type that is taken on trust) and media (the stored bytes) of every text.

    The UTF-8 bytes of the text (null: empty) are filled up with bytes 255 to a positive multiple of UNIT and
    stored as 8-bit samples. A null id stays null; repeated rows give a row each; an empty table gives none.
    Other columns are not carried, so their names cannot clash.
    """

    def make():
        def work(texts):
            raw = [t.encode("utf-8") for t in texts]
            media = [to_wav(x + b"\xff" * (-len(x) % UNIT if x else UNIT)) for x in raw]
            return {
                "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "declared": ["application/octet-stream"] * len(raw),
                "media": pa.array(media, pa.binary()),
            }

        return work

    return map_texts(id_and_text(df, id_col, text_col), make, "n_bytes long, declared string, media binary")


_FOUND = "type string, corrected boolean, length long, embedded array<struct<offset:long,length:long,type:string>>"


def free_name(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """df with a struct column `sniffed`: type, corrected, length, embedded; and `payload`, the samples of 8-bit audio.

    type is that of the valid file at the start, otherwise the declared one if no validator knows it and null
    if the bytes refute it; corrected tells whether it differs from the declared type; length is that file's.
    embedded lists valid files elsewhere. Null or empty media have null type and no embedded files; a null declared type is
    corrected by any found one. Repeated rows give a row each, an empty table none; media of any length are read whole. Where df has
    a column named sniffed or payload, it stays, and the new one's name gets a _ at its end.
    """
    kept, taken = df.schema.fields, {f.name.lower() for f in df.schema}
    names = [f.name for f in kept]
    new = [free_name("sniffed", taken), free_name("payload", taken)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{new[0]} struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>", f"{new[1]} binary"])
    known = {kind for _, kind, _, _ in FORMATS} | set(RIFF_TYPES.values())
    part = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])
    kind_of = pa.struct([("type", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(part))])

    def look(data: bytes | None, declared: str | None) -> tuple[dict, bytes | None]:
        found = sniff(data) if data else []
        whole = next((x for x in found if x[0] == 0), None)
        rest = [dict(zip(("offset", "length", "type"), x)) for x in found if x != whole]
        kind = whole[2] if whole else None if declared in known or not data else declared
        row = {"type": kind, "corrected": kind != declared, "length": whole[1] if whole else None, "embedded": rest}
        return row, wav_samples(data) if kind == "audio/wav" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                media, declared = batch.column(media_col).to_pylist(), batch.column(declared_col).to_pylist()
                found = [look(*x) for x in zip(media, declared)]
                columns = [*(batch.column(n) for n in names), pa.array([x for x, _ in found], kind_of), pa.array([p for _, p in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return df.mapInArrow(run, schema)


def carve_media(sniffed: DataFrame, media_col: str = "media", found_col: str = "sniffed") -> DataFrame:
    """A row for each file embedded in media: the columns of sniffed, and `carved`: its place in the list, offset, length, type and bytes.

    Media that are null, empty or hold no other file give no rows; files inside files are carved too; repeated rows give theirs
    each. Where sniffed has a column named carved, it stays, and the new one's name gets a _ at its end.
    """
    new = free_name("carved", {c.lower() for c in sniffed.columns})
    rows = sniffed.select("*", F.posexplode(F.col(f"`{found_col}`.embedded")).alias("_place", "_file"))
    data = F.substring(F.col(f"`{media_col}`"), (F.col("_file.offset") + 1).cast("int"), F.col("_file.length").cast("int"))
    carved = F.struct(F.col("_place").alias("place"), F.col("_file.offset"), F.col("_file.length"), F.col("_file.type"), data.alias("bytes"))
    return rows.select(*[F.col(f"`{c}`") for c in sniffed.columns], carved.alias(new))


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of stored texts as sniff_media reads them back, and a feature string of what was found.

    A row for each row of store_texts: null and empty texts have the digests of one unit of filling, equal texts have equal
    values, a null id stays null, an empty table gives none. Other columns are not carried.
    """
    seen = sniff_media(stored)
    inner = F.transform(F.col("sniffed.embedded"), lambda e: F.concat_ws(":", e["type"], e["offset"], e["length"]))
    feature = F.concat_ws(
        ";", F.col("sniffed.type"), F.concat(F.lit("was="), F.col("declared")), F.concat(F.lit("length="), F.col("sniffed.length")),
        F.concat(F.lit("embedded="), F.array_join(inner, ",")),
    )
    size = F.octet_length("payload").cast("long")
    return seen.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
