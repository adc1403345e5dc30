"""Binary scan formats: LAS (uncompressed), PLY, PCD and PTX, read as files through Spark and decoded column-wise."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, point_id long, x double, y double, z double, intensity int, class int, return_number int, return_count int, source_id int, gps_time double, r int, g int, b int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

# Fields of a LAS point record by format, and the bytes at which time and colour start.
_LEGACY = {0: (20, None, None), 1: (28, 20, None), 2: (26, None, 20), 3: (34, 20, 28)}
_EXTENDED = {6: (30, 22, None), 7: (36, 22, 30), 8: (38, 22, 30)}
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}


def sniff(head: bytes, name: str = "") -> str:
    """Format by its first bytes, then by the file name's ending."""
    if head[:8] == b"ASTM-E57":
        return "e57"
    if head[:4] == b"LASF":
        return "laz" if len(head) > 104 and head[104] & 0x80 else "las"
    if head[:4] == b"glTF":
        return "glb"
    if head[:3] == b"ply":
        return "ply"
    if any(line.startswith((b"VERSION", b"FIELDS")) for line in head[:256].splitlines()):
        return "pcd"
    end = name.rpartition(".")[2].lower()
    return {"csv": "xyz", "asc": "xyz", "txt": "xyz"}.get(end, end if end in ("xyz", "pts", "ptx", "obj", "ply", "pcd", "las", "laz", "e57", "gltf", "glb") else "unknown")


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, size, offset = data[25], *struct.unpack_from("<HI", data, 94)
    kind, width, count = data[104], *struct.unpack_from("<HI", data, 105)
    if kind & 0x80:
        raise ValueError("compressed LAZ records are not supported")
    if minor >= 4 and size >= 255 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    if offset + count * width > len(data):
        raise ValueError(f"the header declares {count} points, the file has room for {max(0, len(data) - offset) // max(width, 1)}")
    return {"version": f"1.{minor}", "format": kind, "width": width, "count": count, "offset": offset, "scale": scale, "shift": shift}


def decode_las(data: bytes) -> dict[str, np.ndarray | None]:
    h = las_header(data)
    width, n, kind = h["width"], h["count"], h["format"]
    if kind not in _LEGACY and kind not in _EXTENDED:
        raise ValueError(f"point format {kind} is not supported")
    extended = kind in _EXTENDED
    least, time_at, rgb_at = (_EXTENDED if extended else _LEGACY)[kind]
    if width < least:
        raise ValueError("records are too short for their format")
    raw = np.frombuffer(data, np.uint8, n * width, h["offset"]).reshape(n, width)
    at = lambda i, t: np.ascontiguousarray(raw[:, i : i + np.dtype(t).itemsize]).view(t)[:, 0]
    out = {c: at(4 * i, "<i4") * h["scale"][i] + h["shift"][i] for i, c in enumerate("xyz")}
    flags = raw[:, 14]
    out |= {"intensity": at(12, "<u2"), "return_number": flags & (15 if extended else 7), "return_count": flags >> 4 if extended else flags >> 3 & 7}
    out |= {"class": raw[:, 16] if extended else raw[:, 15] & 31, "source_id": at(20 if extended else 18, "<u2")}
    out["gps_time"] = at(time_at, "<f8") if time_at else None
    rgb = [at(rgb_at + 2 * i, "<u2") for i in range(3)] if rgb_at else [None] * 3
    if rgb_at and n and max(int(c.max()) for c in rgb) > 255:
        rgb = [c >> 8 for c in rgb]
    return out | dict(zip("rgb", rgb, strict=True))


def decode_ply(data: bytes) -> dict[str, np.ndarray | None]:
    end = data.index(b"end_header") + len(b"end_header")
    end += 2 if data[end : end + 2] == b"\r\n" else 1
    kind, n, fields, here = "ascii", 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            here = w[1] == "vertex"
            n = int(w[2]) if here else n
        elif w[:1] == ["property"] and here:
            if w[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            fields.append((w[2], _PLY_TYPES[w[1]]))
    if kind == "ascii":
        rows = np.array([line.split()[: len(fields)] for line in data[end:].decode().splitlines() if line.strip()][:n], float).reshape(-1, len(fields))
        cols = {f: rows[:, i] for i, (f, _) in enumerate(fields)}
    else:
        order = ">" if kind == "binary_big_endian" else "<"
        t = np.frombuffer(data, np.dtype([(f, k.replace("<", order)) for f, k in fields]), n, end)
        cols = {f: t[f] for f, _ in fields}
    get = lambda *names: next((cols[c] for c in names if c in cols), None)
    return {"x": get("x"), "y": get("y"), "z": get("z"), "intensity": get("intensity", "scalar_Intensity"), "class": get("classification", "class", "label"), "r": get("red", "r"), "g": get("green", "g"), "b": get("blue", "b")}


def lzf_unpack(data: bytes, size: int) -> bytes:
    """LZF: a control byte below 32 is followed by that many bytes and one; others name a length and a way back."""
    out = bytearray()
    i = 0
    while i < len(data):
        control = data[i]
        i += 1
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[i]
            i += 1
        start = len(out) - ((control & 31) << 8 | data[i]) - 1
        i += 1
        if start < 0:
            raise ValueError("LZF data point before their start")
        for k in range(length + 2):  # may overlap what it writes
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError(f"LZF data declare {size} bytes and hold {len(out)}")
    return bytes(out)


def decode_ptx(data: bytes) -> dict[str, np.ndarray | None]:
    """All scans of a PTX file, each by its 4 x 4 matrix (rows from the left, shift in the last; unity if it is broken).

    Points at 0 0 0 are no returns; lines of fewer than four numbers and a truncated end are skipped.  Intensities of 1
    at most are shares of 65535.  source_id counts the scans.
    """
    lines = data.decode("utf-8", "replace").splitlines()
    blocks, i, scan = [], 0, 0

    def number(t: str) -> float:
        try:
            return float(t)
        except ValueError:
            return float("nan")

    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        head = [number((lines[k].split() or [""])[0]) for k in (i, i + 1) if k < len(lines)]
        if len(head) < 2 or i + 10 > len(lines) or not all(h >= 0 and h == int(h) for h in head):
            break
        total, scan = int(head[0]) * int(head[1]), scan + 1
        rows = [[number(t) for t in line.split()[:4]] for line in lines[i + 6 : i + 10]]
        m = np.array([r + [float("nan")] * (4 - len(r)) for r in rows])
        m = m if np.isfinite(m).all() else np.eye(4)
        body = [line.split() for line in lines[i + 10 : i + 10 + total]]
        i += 10 + total
        body = [[number(t) for t in (b + ["nan"] * 7)[:7]] for b in body if len(b) >= 4]
        p = np.array(body).reshape(-1, 7)
        p = p[np.isfinite(p[:, :3]).all(1) & (p[:, :3] != 0).any(1)]
        blocks.append(np.column_stack([p[:, :3] @ m[:3, :3] + m[3, :3], p[:, 3:], np.full(len(p), scan)]))
    t = np.concatenate(blocks) if blocks else np.empty((0, 8))
    shade = np.nan_to_num(t[:, 3])
    shade = np.clip(np.floor(shade * (65535 if len(shade) and 0 < shade.max() <= 1 else 1) + 0.5), 0, 65535)
    out = {"x": t[:, 0], "y": t[:, 1], "z": t[:, 2], "intensity": shade, "source_id": t[:, 7]}
    if len(t) and np.isfinite(t[0, 4:7]).all():
        out |= {c: np.clip(np.floor(np.nan_to_num(t[:, 4 + k]) + 0.5), 0, 255) for k, c in enumerate("rgb")}
    return out


def decode_pcd(data: bytes) -> dict[str, np.ndarray | None]:
    head, at = {}, 0
    while "DATA" not in head:
        to = data.index(b"\n", at)
        line = data[at:to].decode("ascii", "replace").strip()
        if line and not line.startswith("#"):
            k, _, v = line.partition(" ")
            head[k] = v.split()
        at = to + 1
    n = int(head.get("POINTS", [str(int(head["WIDTH"][0]) * int(head["HEIGHT"][0]))])[0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    kinds = [{"F": "<f", "I": "<i", "U": "<u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    if head["DATA"][0] == "ascii":
        rows = np.array([line.split() for line in data[at:].decode().splitlines() if line.strip()][:n], float)
        place = np.cumsum([0, *counts])
        cols = {f: rows[:, place[i]] for i, f in enumerate(head["FIELDS"])}
    elif head["DATA"][0] == "binary":
        t = np.frombuffer(data, np.dtype([(f"{f}{i}", k, (c,)) for i, (f, k, c) in enumerate(zip(head["FIELDS"], kinds, counts, strict=True))]), n, at)
        cols = {f: t[f"{f}{i}"][:, 0] for i, f in enumerate(head["FIELDS"])}
    elif head["DATA"][0] == "binary_compressed":  # all of the first field, then all of the second, and so on
        packed, plain = struct.unpack_from("<II", data, at)
        raw = lzf_unpack(data[at + 8 : at + 8 + packed], plain)
        cols, place = {}, 0
        for f, k, c in zip(head["FIELDS"], kinds, counts, strict=True):
            cols[f] = np.frombuffer(raw, k, n * c, place).reshape(n, c)[:, 0]
            place += n * c * np.dtype(k).itemsize
    else:
        raise ValueError(f"PCD data {head['DATA'][0]} is not supported")
    out = {c: cols.get(c) for c in "xyz"} | {"intensity": cols.get("intensity"), "class": cols.get("label")}
    if (rgb := cols.get("rgb", cols.get("rgba"))) is not None:
        bits = np.ascontiguousarray(rgb.astype("<f4")).view("<u4") if rgb.dtype.kind == "f" else rgb.astype(np.uint32)
        out |= {"r": bits >> 16 & 255, "g": bits >> 8 & 255, "b": bits & 255}
    return out


DECODERS = {"las": decode_las, "ply": decode_ply, "pcd": decode_pcd, "ptx": decode_ptx}
CHUNK = 500_000


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Points of all LAS, PLY, PCD and PTX files under a path: one task per file, rows without finite coordinates dropped.

    Colours above 255 are brought to bytes; what a format lacks is null.  point_id counts within its file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                kind = sniff(data[:512], name)
                if kind not in DECODERS:
                    raise ValueError(f"{name}: format {kind} is not supported")
                cols = DECODERS[kind](data)
                good = np.flatnonzero(np.isfinite(cols["x"]) & np.isfinite(cols["y"]) & np.isfinite(cols["z"]))
                for at in range(0, len(good), CHUNK):
                    i = good[at : at + CHUNK]
                    out = [pa.array([name] * len(i)), pa.array(i)]
                    for c in schema.names[2:]:
                        v = cols.get(c)
                        t = schema.field(c).type
                        out.append(pa.nulls(len(i), t) if v is None else pa.array(np.asarray(v)[i].astype(np.float64 if t == pa.float64() else np.int32), t))
                    yield pa.RecordBatch.from_arrays(out, schema=schema)

    return files.mapInArrow(run, SCHEMA)


def encode_las(cols: dict[str, np.ndarray], scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of format 0 or 2 from arrays x, y, z and optionally intensity, class and r, g, b."""
    n = len(cols["x"])
    rgb = all(c in cols for c in "rgb")
    width = 26 if rgb else 20
    shift = [float(np.floor(cols[c].min())) if n else 0.0 for c in "xyz"]
    raw = np.zeros((n, width), np.uint8)
    for i, c in enumerate("xyz"):
        whole = np.floor((cols[c] - shift[i]) / scale + 0.5)
        if n and np.abs(whole).max() > 2**31 - 1:
            raise ValueError(f"{c} does not fit 32-bit records at scale {scale}")
        raw[:, 4 * i : 4 * i + 4] = whole.astype("<i4")[:, None].view(np.uint8)
    raw[:, 12:14] = np.asarray(cols.get("intensity", np.zeros(n))).astype("<u2")[:, None].view(np.uint8)
    raw[:, 14] = 1 | 1 << 3
    raw[:, 15] = np.asarray(cols.get("class", np.zeros(n))).astype(np.uint8) & 31
    if rgb:
        raw[:, 20:26] = np.ascontiguousarray(np.stack([np.asarray(cols[c]).astype("<u2") * 257 for c in "rgb"], 1)).view(np.uint8)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    head[58:65] = b"talus\0\0"
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 2 if rgb else 0, width, n)
    struct.pack_into("<5I", head, 111, n, 0, 0, 0, 0)
    struct.pack_into("<6d", head, 131, *[scale] * 3, *shift)
    box = [v for c in "xyz" for v in ((cols[c].max(), cols[c].min()) if n else (0.0, 0.0))]
    struct.pack_into("<6d", head, 179, *box)
    return bytes(head) + raw.tobytes()


def encode_las14(cols: dict[str, np.ndarray], scale: float = 0.001, wkt: str = "") -> bytes:
    """A LAS 1.4 file of format 6 or 7 from arrays x, y, z and optionally intensity, class, gps_time, source_id and r, g, b.

    The coordinate system goes as well-known text into a variable-length record.
    """
    n = len(cols["x"])
    rgb = all(c in cols for c in "rgb")
    width = 36 if rgb else 30
    shift = [float(np.floor(cols[c].min())) if n else 0.0 for c in "xyz"]
    raw = np.zeros((n, width), np.uint8)
    put = lambda at, v, kind: raw.__setitem__((slice(None), slice(at, at + np.dtype(kind).itemsize)), np.ascontiguousarray(np.asarray(v).astype(kind))[:, None].view(np.uint8))
    for i, c in enumerate("xyz"):
        whole = np.floor((cols[c] - shift[i]) / scale + 0.5)
        if n and np.abs(whole).max() > 2**31 - 1:
            raise ValueError(f"{c} does not fit 32-bit records at scale {scale}")
        put(4 * i, whole, "<i4")
    none = np.zeros(n)
    put(12, cols.get("intensity", none), "<u2")
    raw[:, 14] = 1 | 1 << 4
    put(16, cols.get("class", none), "u1")
    put(20, cols.get("source_id", none), "<u2")
    put(22, cols.get("gps_time", none), "<f8")
    for i, c in enumerate("rgb" if rgb else ""):
        put(30 + 2 * i, np.asarray(cols[c]) * 257, "<u2")
    text = wkt.encode() + b"\0" if wkt else b""
    if len(text) > 65535:
        raise ValueError("the coordinate system does not fit a record")
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"") + text if wkt else b""
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<H", head, 6, 16)
    head[24:26] = bytes([1, 4])
    head[58:65] = b"talus\0\0"
    struct.pack_into("<HIIBH", head, 94, 375, 375 + len(record), 1 if wkt else 0, 7 if rgb else 6, width)
    struct.pack_into("<6d", head, 131, *[scale] * 3, *shift)
    box = [v for c in "xyz" for v in ((cols[c].max(), cols[c].min()) if n else (0.0, 0.0))]
    struct.pack_into("<6d", head, 179, *box)
    struct.pack_into("<QQ", head, 247, n, n)
    return bytes(head) + record + raw.tobytes()


def las_files(pts: DataFrame, per_file: int = 1_000_000, version: str = "1.2", wkt: str = "") -> DataFrame:
    """part, content: LAS 1.2 or 1.4 files of at most per_file points each, made from consecutive ids."""
    from pyspark.sql import functions as F

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy() for c in t.column_names if c != "part"}
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int64()), "content": pa.array([encode_las14(cols, wkt=wkt) if version == "1.4" else encode_las(cols)], pa.binary())})

    keep = [c for c in ("x", "y", "z", "intensity", "class", "r", "g", "b") if c in pts.columns]
    filled = pts.select(F.floor(F.col("point_id") / per_file).cast("long").alias("part"), *[F.coalesce(c, F.lit(0)).alias(c) if c not in "xyz" else F.col(c) for c in keep])
    return filled.groupBy("part").applyInArrow(run, "part long, content binary")


def copc_nodes(data: bytes) -> list[tuple[int, int, int, int, int, int, int]]:
    """(depth, x, y, z, offset, bytes, points) of a COPC hierarchy page's 32-byte entries; points -1 names a child page."""
    if len(data) % 32:
        raise ValueError("a hierarchy page has entries of 32 bytes")
    return [struct.unpack_from("<4iQii", data, i) for i in range(0, len(data), 32)]


def ept_nodes(spark: SparkSession, path: str) -> DataFrame:
    """key, depth, point_count of EPT hierarchy files: a JSON map from `d-x-y-z` to a count, -1 naming a linked page."""
    from pyspark.sql import functions as F

    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string, bigint>")).alias("key", "point_count"))
    return pairs.withColumn("depth", F.split("key", "-")[0].cast("int"))
