"""HDF5 files without another library: what is in them is looked up by the driver, and where the numbers of a large dataset
lie is a plan that tasks read by.

Read are superblocks 0 to 3, groups with symbol tables or links in their headers, datasets stored in one piece, in their
header, or in chunks with a B-tree, filters deflate and shuffle, and numbers, strings and enumerations. Written are files
of version 0 with datasets in one piece. The layout is that of the published file format specification.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", 0xFFFFFFFFFFFFFFFF
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS = 1, 2, 3, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE = 1, 2


@dataclass
class Dataset:
    """shape, dtype (None: text of variable length), and where the numbers are: ``address`` of one piece, or ``chunks`` with
    (place of the first element, address, stored bytes, filters left out)."""

    shape: tuple[int, ...]
    dtype: np.dtype | None
    address: int | None = None
    inline: bytes | None = None
    chunk: tuple[int, ...] | None = None
    chunks: list[tuple[tuple[int, ...], int, int, int]] = field(default_factory=list)
    filters: tuple[int, ...] = ()

    @property
    def n_bytes(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) * (self.dtype.itemsize if self.dtype is not None else 16)

    def unfiltered(self, raw: bytes, skipped: int = 0) -> bytes:
        """A chunk's bytes after its filters are undone, the last first."""
        for k in reversed(range(len(self.filters))):
            if skipped >> k & 1:
                continue
            if self.filters[k] == DEFLATE:
                raw = zlib.decompress(raw)
            elif self.filters[k] == SHUFFLE:
                size = self.dtype.itemsize
                raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
            else:
                raise NotImplementedError(f"chunks with filter {self.filters[k]} can't be read")
        return raw


class File:
    """An open file; ``tree`` looks up a group's members."""

    def __init__(self, file):
        self.file, self._heaps = file, {}
        head = self._at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        if head[8] in (0, 1):
            at = 24 + 4 * head[8]
            (self.root,) = struct.unpack_from("<Q", head, at + 32 + 8)
        else:
            (self.root,) = struct.unpack_from("<Q", head, 36)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _messages(self, at: int) -> list[tuple[int, bytes]]:
        head = self._at(at, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            begin = at + 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._at(begin, width), "little")
            blocks, order = [(begin + width, size)], 2 * bool(flags & 4)
            while blocks:
                start, n = blocks.pop(0)
                raw, k = self._at(start, n), 0
                while k + 4 <= len(raw):
                    kind, size = struct.unpack_from("<BH", raw, k)
                    body = raw[k + 4 + order : k + 4 + order + size]
                    k += 4 + order + size
                    if kind == CONTINUATION:
                        to, length = struct.unpack("<QQ", body)
                        blocks.append((to + 4, length - 8))
                    elif kind:
                        out.append((kind, body))
            return out
        _, _, _, _, size = struct.unpack_from("<BBHII", head)
        blocks = [(at + 16, size)]
        while blocks:
            start, n = blocks.pop(0)
            raw, k = self._at(start, n), 0
            while k + 8 <= len(raw):
                kind, size = struct.unpack_from("<HH", raw, k)
                body = raw[k + 8 : k + 8 + size]
                k += 8 + size
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                elif kind:
                    out.append((kind, body))
        return out

    def members(self, at: int) -> dict[str, int]:
        """Names of a group and the addresses of what they name; empty for a dataset."""
        out: dict[str, int] = {}
        for kind, body in self._messages(at):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                (data,) = struct.unpack_from("<Q", self._at(heap, 32), 24)
                self._symbols(tree, data, out)
            elif kind == LINK:
                flags, k = body[1], 2
                soft = bool(flags & 8) and body[k] != 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                name = body[k + width : k + width + n].decode()
                if not soft:
                    (out[name],) = struct.unpack_from("<Q", body, k + width + n)
            elif kind == LINK_INFO:
                heap = struct.unpack_from("<Q", body, 2 + 8 * bool(body[1] & 1))[0]
                if heap != UNDEFINED:
                    raise NotImplementedError("groups with densely stored links can't be read")
        return out

    def _symbols(self, at: int, heap: int, out: dict[str, int]) -> None:
        head = self._at(at, 24)
        if head[:4] == b"TREE":
            n = struct.unpack_from("<H", head, 6)[0]
            raw = self._at(at + 24, 16 * n + 8)
            for k in range(n):
                self._symbols(struct.unpack_from("<Q", raw, 16 * k + 8)[0], heap, out)
            return
        n = struct.unpack_from("<H", head, 6)[0]
        raw = self._at(at + 8, 40 * n)
        for k in range(n):
            name, header = struct.unpack_from("<QQ", raw, 40 * k)
            out[self._text_at(heap + name)] = header

    def _text_at(self, at: int) -> str:
        raw = b""
        while b"\0" not in raw:
            more = self._at(at + len(raw), 64)
            if not more:
                break
            raw += more
        return raw.split(b"\0")[0].decode()

    def dataset(self, at: int) -> Dataset | None:
        """What a header says of a dataset; None for a group."""
        found = dict(reversed(self._messages(at)))
        if LAYOUT not in found or DATASPACE not in found:
            return None
        shape, dtype, body = _shape(found[DATASPACE]), _dtype(found[DATATYPE]), found[LAYOUT]
        out = Dataset(shape, dtype, filters=_filters(found.get(FILTERS)))
        if body[0] != 3 and not (body[0] == 4 and body[1] < 2):
            raise NotImplementedError(f"layouts of version {body[0]} can't be read")
        if body[1] == 0:
            out.inline = body[4 : 4 + struct.unpack_from("<H", body, 2)[0]]
        elif body[1] == 1:
            out.address = struct.unpack_from("<Q", body, 2)[0]
        else:
            rank = body[2]
            (tree,) = struct.unpack_from("<Q", body, 3)
            out.chunk = struct.unpack_from(f"<{rank - 1}I", body, 11)
            if tree != UNDEFINED:
                self._chunks(tree, rank, out.chunks)
        return out

    def _chunks(self, at: int, rank: int, out: list) -> None:
        level, n = struct.unpack_from("<BH", self._at(at, 24), 5)
        width = 8 + 8 * rank
        raw = self._at(at + 24, n * (width + 8) + width)
        for k in range(n):
            size, skipped = struct.unpack_from("<II", raw, k * (width + 8))
            place = struct.unpack_from(f"<{rank}Q", raw, k * (width + 8) + 8)[: rank - 1]
            (child,) = struct.unpack_from("<Q", raw, k * (width + 8) + width)
            if level:
                self._chunks(child, rank, out)
            else:
                out.append((place, child, size, skipped))

    def value(self, d: Dataset):
        """A whole dataset; meant for small ones. Text is decoded, and a single value is no array."""
        if d.dtype is None:
            raw = self._at(d.address, d.n_bytes) if d.inline is None else d.inline
            out = np.array([self._heap_text(*struct.unpack_from("<IQI", raw, 16 * k)) for k in range(int(np.prod(d.shape)))], object).reshape(d.shape)
        else:
            if d.chunk is not None:
                out = np.zeros(d.shape, d.dtype)
                for place, at, size, skipped in d.chunks:
                    block = np.frombuffer(d.unfiltered(self._at(at, size), skipped), d.dtype).reshape(d.chunk)
                    part = tuple(slice(p, min(p + c, s)) for p, c, s in zip(place, d.chunk, d.shape, strict=True))
                    out[part] = block[tuple(slice(0, s.stop - s.start) for s in part)]
            else:
                raw = d.inline if d.inline is not None else self._at(d.address, d.n_bytes) if d.address != UNDEFINED else bytes(d.n_bytes)
                out = np.frombuffer(raw[: d.n_bytes], d.dtype).reshape(d.shape)
            if d.dtype.kind == "S":
                out = np.array([v.split(b"\0")[0].decode(errors="replace") for v in out.ravel().tolist()], object).reshape(d.shape)
        return out[()] if out.ndim == 0 else out[0] if out.size == 1 and out.ndim == 1 else out

    def _heap_text(self, n: int, at: int, index: int) -> str:
        if at not in self._heaps:
            size = struct.unpack_from("<Q", self._at(at, 16), 8)[0]
            raw, k, found = self._at(at, size), 16, {}
            while k + 16 <= len(raw):
                i, _, _, length = struct.unpack_from("<HHIQ", raw, k)
                if not i:
                    break
                found[i] = raw[k + 16 : k + 16 + length]
                k += 16 + (length + 7) // 8 * 8
            self._heaps[at] = found
        return self._heaps[at].get(index, b"")[:n].decode(errors="replace")

    def address(self, path: str) -> int | None:
        """Of what a path names; None if there is nothing."""
        at = self.root
        for name in path.strip("/").split("/") if path.strip("/") else []:
            at = self.members(at).get(name)
            if at is None:
                return None
        return at

    def read(self, path: str = "", leave: tuple[str, ...] = ()) -> dict:
        """A group as a dictionary, groups in it as well; datasets named in ``leave`` as a Dataset."""
        return self._read(self.address(path), leave)

    def _read(self, at: int | None, leave: tuple[str, ...]) -> dict:
        out = {}
        for name, where in self.members(at).items() if at is not None else ():
            d = self.dataset(where)
            out[name] = self._read(where, leave) if d is None else d if name in leave else self.value(d)
        return out


def _shape(body: bytes) -> tuple[int, ...]:
    at = 8 if body[0] == 1 else 4
    return struct.unpack_from(f"<{body[1]}Q", body, at)


def _dtype(body: bytes) -> np.dtype | None:
    kind, bits, (size,) = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 8:
        return _dtype(body[8:])
    if kind == 9 and bits & 15 == 1:
        return None
    raise NotImplementedError(f"numbers of class {kind} can't be read")


def _filters(body: bytes | None) -> tuple[int, ...]:
    if body is None:
        return ()
    out, first = [], body[0] == 1
    at = 8 if first else 2
    for _ in range(body[1]):
        (kind,) = struct.unpack_from("<H", body, at)
        named = first or kind >= 256
        name = struct.unpack_from("<H", body, at + 2)[0] if named else 0
        at += 2 + 2 * named
        _, n = struct.unpack_from("<HH", body, at)
        at += 4 + name + 4 * (n + n % 2 * first)
        out.append(kind)
    return tuple(out)


# Writing

@dataclass(frozen=True)
class Later:
    """A dataset whose numbers come behind everything else in the file, and are written by others."""

    shape: tuple[int, ...]
    dtype: str


def _type_message(dtype: np.dtype) -> bytes:
    size = dtype.itemsize
    if dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, size, 0, 8 * size)
    if dtype.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, size)
    exponent, mantissa, bias = (8, 23, 127) if size == 4 else (11, 52, 1023)
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)


def _header(messages: list[tuple[int, bytes]]) -> bytes:
    body = b""
    for kind, data in messages:
        data += bytes(-len(data) % 8)
        body += struct.pack("<HHB3x", kind, len(data), 0) + data
    return struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body


def file_bytes(tree: dict) -> bytes:
    """A file of nested dictionaries of numbers, arrays and texts. If one of them is ``Later``, the bytes end where its
    numbers begin."""
    out = bytearray(96)
    later: list[tuple[int, Later]] = []
    leaf = max(4, (_widest(tree) + 1) // 2)

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def dataset(value) -> int:
        if isinstance(value, Later):
            shape, dtype, raw = value.shape, np.dtype(value.dtype), None
        else:
            array = np.asarray(value.encode() if isinstance(value, str) else value)
            array = array.astype("S") if array.dtype.kind in "OU" else array
            array = array.astype("<u1") if array.dtype.kind == "b" else array.astype(array.dtype.newbyteorder("<"))
            array = array.astype("S1") if array.dtype.kind == "S" and not array.dtype.itemsize else array
            shape, dtype, raw = array.shape, array.dtype, array.tobytes()
        at = UNDEFINED if raw is None or not raw else put(raw)
        size = int(np.prod(shape, dtype=np.int64)) * dtype.itemsize
        space = struct.pack(f"<BBBB4x{len(shape)}Q", 1, len(shape), 0, 0, *shape)
        head = put(_header([(DATASPACE, space), (DATATYPE, _type_message(dtype)), (5, bytes([2, 2, 0, 0])), (LAYOUT, struct.pack("<BBQQ", 3, 1, at, size))]))
        if raw is None:
            place = out.index(struct.pack("<BBQQ", 3, 1, UNDEFINED, size), head) + 2
            later.append((place, value))
        return head

    def group(members: dict) -> tuple[int, int, int]:
        names = sorted(members, key=str.encode)
        at = [group(members[n])[0] if isinstance(members[n], dict) else dataset(members[n]) for n in names]
        heap, places = bytearray(8), []
        for n in names:
            places.append(len(heap))
            heap += n.encode() + b"\0"
            heap += bytes(-len(heap) % 8)
        data = put(bytes(heap))
        heap_at = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))
        symbols = b"".join(struct.pack("<QQII16x", p, a, 0, 0) for p, a in zip(places, at, strict=True))
        node = put(b"SNOD" + struct.pack("<BBH", 1, 0, len(names)) + symbols + bytes(40 * (2 * leaf - len(names))))
        # a tree of one node, with room for 32 children
        tree_at = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1 if names else 0, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, places[-1] if names else 0) + bytes(32 * 16 + 8 - 24))
        return put(_header([(SYMBOLS, struct.pack("<QQ", tree_at, heap_at))])), tree_at, heap_at

    root, tree_at, heap_at = group(tree)
    out.extend(bytes(-len(out) % 8))
    end = len(out)
    if len(later) > 1:
        raise ValueError("one dataset can be written later")
    for place, value in later:
        struct.pack_into("<Q", out, place, end)
        end += int(np.prod(value.shape, dtype=np.int64)) * np.dtype(value.dtype).itemsize
    struct.pack_into("<8sBBBBBBBBHHIQQQQQQIIQQ", out, 0, SIGNATURE, 0, 0, 0, 0, 0, 8, 8, 0, leaf, 16, 0, 0, UNDEFINED, end, UNDEFINED, 0, root, 1, 0, tree_at, heap_at)
    return bytes(out)


def _widest(tree: dict) -> int:
    return max([len(tree), *(_widest(v) for v in tree.values() if isinstance(v, dict))])
