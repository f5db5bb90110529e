"""Record codecs of the file formats: FASTA/FASTQ, SLOW5/BLOW5, BAM, pore models. Pure Python and numpy, from the public format descriptions."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np


def opened(path: str):
    f = open(path.removeprefix("file://"), "rb")
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f


def read_fastx(path: str) -> Iterator[tuple[int, str, str, str]]:
    """ordinal, name, comment, sequence of multi-line FASTA or FASTQ."""
    ordinal, head, seq, quality = 0, None, [], None
    with opened(path) as f:
        for raw in f:
            line = raw.decode().rstrip("\r\n")
            if quality is not None:
                quality += len(line)
                if quality >= sum(map(len, seq)):
                    quality = None
                    name, _, comment = head.partition(" ")
                    yield ordinal, name, comment, "".join(seq)
                    ordinal, head, seq = ordinal + 1, None, []
                continue
            if line[:1] in (">", "@") and (line[0] == ">" or head is None):
                if head is not None:
                    name, _, comment = head.partition(" ")
                    yield ordinal, name, comment, "".join(seq)
                    ordinal += 1
                head, seq = line[1:].replace("\t", " "), []
            elif line[:1] == "+" and head is not None:
                quality = 0
            elif head is not None:
                seq.append(line.strip())
        if head is not None:
            name, _, comment = head.partition(" ")
            yield ordinal, name, comment, "".join(seq)


# --- signal codecs ---------------------------------------------------------


def svb_decode(data: bytes, n: int) -> np.ndarray:
    """n unsigned 32-bit values: two bits of length each, then the bytes."""
    keys = np.frombuffer(data, dtype=np.uint8, count=(n + 3) // 4)
    sizes = ((keys[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(-1)[:n].astype(np.int64) + 1
    body = np.frombuffer(data, dtype=np.uint8, offset=len(keys))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        has = sizes > k
        out[has] |= body[at[:-1][has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def svb_encode(values: np.ndarray) -> bytes:
    v = values.astype(np.uint32)
    sizes = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros((len(v) + 3) // 4 * 4, dtype=np.uint8)
    codes[: len(v)] = sizes - 1
    keys = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(at[-1], dtype=np.uint8)
    for k in range(4):
        has = sizes > k
        body[at[:-1][has] + k] = (v[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return keys.tobytes() + body.tobytes()


def zigzag(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int32)
    return ((d << 1) ^ (d >> 31)).astype(np.uint32)


def unzigzag(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.uint32)
    return (z >> np.uint32(1)).astype(np.int32) ^ -(z & np.uint32(1)).astype(np.int32)


def svbzd_encode(samples: np.ndarray) -> bytes:
    return struct.pack("<I", len(samples)) + svb_encode(zigzag(np.diff(samples.astype(np.int32), prepend=0)))


def svbzd_decode(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    return np.cumsum(unzigzag(svb_decode(data[4:], n))).astype(np.int16)


def exzd_encode(samples: np.ndarray) -> bytes:
    """Version 0: shared low zero bits dropped, zigzag deltas as bytes, larger ones as exceptions."""
    x = samples.astype(np.int16)
    q = next((k for k in range(5, 0, -1) if len(x) and not (x & ((1 << k) - 1)).any()), 0)
    head = struct.pack("<BQB", 0, len(x), q)
    if not len(x):
        return head
    z = zigzag(np.diff((x >> q).astype(np.int32), prepend=0))
    rest = z[1:]
    at = np.flatnonzero(rest > 255)
    out = head + struct.pack("<HI", int(z[0]) & 0xFFFF, len(at))
    if len(at) == 1:
        out += struct.pack("<II", int(at[0]), int(rest[at[0]]) - 256)
    elif len(at):
        where, what = svb_encode(np.diff(at, prepend=-1) - 1), svb_encode(rest[at] - 256)
        out += struct.pack("<I", len(where)) + where + struct.pack("<I", len(what)) + what
    return out + rest[rest <= 255].astype(np.uint8).tobytes()


def exzd_decode(data: bytes) -> np.ndarray:
    version, n, q = struct.unpack_from("<BQB", data)
    if version != 0:
        raise ValueError(f"unknown version {version} of ex-zd")
    if not n:
        return np.empty(0, dtype=np.int16)
    first, count = struct.unpack_from("<HI", data, 10)
    at, where, what = 16, np.empty(0, np.int64), np.empty(0, np.uint32)
    if count == 1:
        p, v = struct.unpack_from("<II", data, at)
        at, where, what = at + 8, np.array([p]), np.array([v], dtype=np.uint32)
    elif count:
        (size,) = struct.unpack_from("<I", data, at)
        where = np.cumsum(svb_decode(data[at + 4 : at + 4 + size], count).astype(np.int64) + 1) - 1
        at += 4 + size
        (size,) = struct.unpack_from("<I", data, at)
        what = svb_decode(data[at + 4 : at + 4 + size], count)
        at += 4 + size
    rest = np.empty(n - 1, dtype=np.uint32)
    small = np.ones(n - 1, dtype=bool)
    small[where] = False
    rest[where] = what + 256
    rest[small] = np.frombuffer(data, dtype=np.uint8, offset=at, count=int(n - 1 - count))
    return (np.cumsum(unzigzag(np.concatenate([[first], rest]).astype(np.uint32))) << q).astype(np.int16)


def record_codec(code: int):
    """(compress, decompress) of whole records: none, zlib, zstd."""
    if code == 0:
        return bytes, bytes
    if code == 1:
        return zlib.compress, zlib.decompress
    if code == 2:
        import zstandard

        return lambda b: zstandard.ZstdCompressor().compress(b), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)
    raise ValueError(f"unknown record compression {code}")


SIGNAL = {0: (lambda x: x.astype("<i2").tobytes(), lambda b: np.frombuffer(b, dtype="<i2")), 1: (svbzd_encode, svbzd_decode), 2: (exzd_encode, exzd_decode)}
MAGIC, END = b"BLOW5\x01", b"5WOLB"
PRIMARY = ["read_id", "read_group", "digitisation", "offset", "range", "sampling_rate", "len_raw_signal", "raw_signal"]
SIZES = {"int8_t": "b", "uint8_t": "B", "int16_t": "h", "uint16_t": "H", "int32_t": "i", "uint32_t": "I", "int64_t": "q", "uint64_t": "Q", "float": "f", "double": "d", "char": "c"}


def parse_header(lines: list[str]) -> dict:
    """Attributes by read group, and types of the auxiliary columns."""
    groups, attributes = 1, {}
    types: list[str] = []
    names: list[str] = []
    for line in lines:
        if line.startswith("#slow5_version"):
            continue
        if line.startswith("#num_read_groups"):
            groups = int(line.split("\t")[1])
        elif line.startswith("@"):
            key, *values = line[1:].split("\t")
            if key in attributes:
                raise ValueError(f"attribute {key} stands twice in the header")
            attributes[key] = ["" if v == "." else v for v in (values + ["."] * groups)[:groups]]
        elif line.startswith("#char*"):
            types = line[1:].split("\t")
        elif line.startswith("#read_id"):
            names = line[1:].split("\t")
    return {"groups": groups, "attributes": attributes, "aux": list(zip(names[len(PRIMARY) :], types[len(PRIMARY) :]))}


def read_slow5(path: str) -> Iterator[dict]:
    with opened(path) as f:
        lines = []
        for raw in f:
            line = raw.decode().rstrip("\n")
            if line[:1] in "#@":
                lines.append(line)
                continue
            if lines is not None and not isinstance(lines, dict):
                lines = parse_header(lines)
            v = line.split("\t")
            aux = {n: x for (n, _), x in zip(lines["aux"], v[len(PRIMARY) :]) if x != "."}
            signal = np.array(v[7].split(",") if v[7] else [], dtype=np.int16)
            if len(signal) != int(v[6]):
                raise ValueError(f"{v[0]}: len_raw_signal is {v[6]}, but there are {len(signal)} samples")
            yield {"read_id": v[0], "read_group": int(v[1]), "digitisation": float(v[2]), "offset": float(v[3]), "range": float(v[4]), "sampling_rate": float(v[5]), "len_raw_signal": int(v[6]), "raw_signal": signal.tolist(), "aux": aux}


def read_blow5(path: str) -> Iterator[dict]:
    with opened(path) as f:
        head = f.read(64)
        if head[:6] != MAGIC:
            raise ValueError(f"{path} is no BLOW5 file")
        version = tuple(head[6:9])
        record, groups = struct.unpack_from("<BI", head, 9)
        signal = head[14] if version >= (0, 2, 0) else 0
        (size,) = struct.unpack("<I", f.read(4))
        header = parse_header(f.read(size).decode().splitlines())
        unpack, decode = record_codec(record)[1], SIGNAL[signal][1]
        while True:
            size = f.read(8)
            if size[:5] == END or len(size) < 8:
                return
            data = unpack(f.read(struct.unpack("<Q", size)[0]))
            (n,) = struct.unpack_from("<H", data)
            read_id = data[2 : 2 + n].decode()
            group, digitisation, offset, range_, rate, length = struct.unpack_from("<IddddQ", data, 2 + n)
            at = 2 + n + 44
            size = length if signal else 2 * length
            samples, at = decode(data[at : at + size]), at + size
            aux = {}
            for name, kind in header["aux"]:
                base = kind.rstrip("*")
                code = "B" if base.startswith("enum") else SIZES[base]
                count = 1
                if kind.endswith("*"):
                    (count,) = struct.unpack_from("<Q", data, at)
                    at += 8
                values = struct.unpack_from(f"<{count}{code}", data, at)
                at += struct.calcsize(f"<{count}{code}")
                if code == "c":
                    text = b"".join(values).decode()
                    if text.strip("\0"):
                        aux[name] = text
                else:
                    aux[name] = ",".join(map(str, values))
            yield {"read_id": read_id, "read_group": group, "digitisation": digitisation, "offset": offset, "range": range_, "sampling_rate": rate, "len_raw_signal": len(samples), "raw_signal": samples.tolist(), "aux": aux}


def blow5_header(record: int, signal: int, attributes: dict[str, str]) -> bytes:
    text = "#slow5_version\t0.2.0\n#num_read_groups\t1\n" + "".join(f"@{k}\t{v or '.'}\n" for k, v in sorted(attributes.items()))
    text += "#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*\n#" + "\t".join(PRIMARY) + "\n"
    head = MAGIC + bytes((0, 2, 0)) + struct.pack("<BIB", record, 1, signal)
    return head.ljust(64, b"\0") + struct.pack("<I", len(text)) + text.encode()


def blow5_record(row: dict, record: int, signal: int) -> bytes:
    x = np.asarray(row["raw_signal"], dtype=np.int16)
    body = SIGNAL[signal][0](x)
    name = row["read_id"].encode()
    data = struct.pack("<H", len(name)) + name + struct.pack("<IddddQ", row["read_group"], row["digitisation"], row["offset"], row["range"], row["sampling_rate"], len(body) if signal else len(x)) + body
    data = record_codec(record)[0](data)
    return struct.pack("<Q", len(data)) + data


# --- BAM -------------------------------------------------------------------

CIGAR, BASE = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def bgzf(path: str):
    """The inflated bytes; BGZF is a series of gzip members."""
    return gzip.open(path.removeprefix("file://"), "rb")


def read_bam(path: str) -> Iterator[dict]:
    with bgzf(path) as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        contigs = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            (n,) = struct.unpack("<i", f.read(4))
            contigs.append(f.read(n)[:-1].decode())
            f.read(4)
        ordinal = 0
        while len(size := f.read(4)) == 4:
            data = f.read(struct.unpack("<i", size)[0])
            ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", data)
            at = 32
            name, at = data[at : at + n_name - 1].decode(), at + n_name
            ops = [{"op": CIGAR[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{n_ops}I", data, at)]
            at += 4 * n_ops
            seq = "".join(BASE[b >> 4] + BASE[b & 15] for b in data[at : at + (n_seq + 1) // 2])[:n_seq]
            at += (n_seq + 1) // 2 + n_seq
            nm = None
            while at + 3 <= len(data):
                tag, kind = data[at : at + 2], chr(data[at + 2])
                at += 3
                if kind in "ZH":
                    at = data.index(b"\0", at) + 1
                elif kind == "B":
                    sub, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
                    at += 5 + count * struct.calcsize("<" + sub)
                else:
                    code = "c" if kind == "A" else kind.replace("c", "b").replace("C", "B").replace("s", "h").replace("S", "H")
                    (value,) = struct.unpack_from("<" + code, data, at)
                    at += struct.calcsize("<" + code)
                    if tag == b"NM":
                        nm = int(value)
            end = pos + sum(o["len"] for o in ops if o["op"] in "MDN=X")
            yield {"read_index": ordinal, "qname": name, "flag": flag, "contig": contigs[ref] if ref >= 0 else None, "pos": pos, "mapq": mapq, "cigar": ops, "ref_end": end, "nm": nm, "seq": seq}
            ordinal += 1


def read_model(path: str) -> tuple[int, list[tuple[str, float, float]]]:
    """k and rows (k-mer, level mean, level stdv) in rank order; the number of rows must be 4 or 5 to the k."""
    k, rows = 9, []
    with opened(path) as f:
        for raw in f:
            line = raw.decode().strip()
            if line.startswith("#k"):
                k = int(line.split()[1])
            elif line and line[0] != "#" and not line.startswith("kmer"):
                kmer, mean, stdv = line.split()[:3]
                rows.append((kmer, float(mean), float(stdv)))
    if len(rows) not in (4**k, 5**k):
        k = len(rows[0][0]) if rows else k
        if len(rows) not in (4**k, 5**k):
            raise ValueError(f"{path}: {len(rows)} rows are no full model of {k}-mers")
    return k, rows
