"""HDF5 files by their public layout: where things lie is read first, values by ranges of rows.

Read: superblocks 0 to 3, old and compact new groups, contiguous, compact and chunked data (B-trees of
the first version) with deflate, shuffle and checksum filters, numbers, fixed and variable strings,
arrays, compounds and variable-length values in global heaps. Written: the oldest layout of each, which
every reader knows. What is not known raises a ValueError. All numbers are little-endian, addresses and
lengths 8 bytes.

Files are opened by URI through pyarrow's file systems; plain paths are local.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NONE = 0xFFFFFFFFFFFFFFFF
PAGE = 1 << 16
PAGES = 128
#: Bytes of a global heap that a writer fills before it begins the next one.
HEAP = 1 << 16
#: Fixed values of the format: numbers of header messages and of filters.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


def filesystem(uri: str):
    """(file system, path) of a URI or local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Type:
    """kind: number, string, compound, array or vlen; base of array and vlen; members of compound."""

    kind: str
    dtype: np.dtype
    base: Type | None = None
    members: tuple = ()
    text: bool = False


VLEN = np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])


def typed(dtype) -> Type:
    """Of a NumPy type; complex numbers are pairs r, i."""
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        part = f"<f{dtype.itemsize // 2}"
        return typed([("r", part), ("i", part)])
    if dtype.subdtype:
        return Type("array", dtype, typed(dtype.subdtype[0]))
    if dtype.names:
        return Type("compound", dtype, members=tuple((n, dtype.fields[n][1], typed(dtype.fields[n][0])) for n in dtype.names))
    return Type("string" if dtype.kind == "S" else "number", dtype)


def compound(members: list[tuple[str, Type]]) -> Type:
    dtype = np.dtype([(n, t.dtype) for n, t in members])
    return Type("compound", dtype, members=tuple((n, dtype.fields[n][1], t) for n, t in members))


def vlen(base, text: bool = False) -> Type:
    return Type("vlen", VLEN, typed(base), text=text)


# Reading


@dataclass
class Dataset:
    file: File
    type: Type
    shape: tuple[int, ...]
    #: compact: bytes; contiguous: address; chunked: address of the B-tree.
    layout: str
    at: int | bytes
    chunk: tuple[int, ...] = ()
    filters: list[int] = field(default_factory=list)

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.type.dtype.itemsize

    def chunks(self, start: int = 0, stop: int | None = None) -> list[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, bytes, filter mask) of the chunks that hold rows from start to stop; only
        branches of the index that can hold some are read."""
        stop = self.shape[0] if stop is None else stop
        out, ndim = [], len(self.shape)
        width = 8 + 8 * (ndim + 1)

        def walk(at):
            if at == NONE:
                return
            head = self.file.read(at, 24)
            if head[:4] != b"TREE" or head[4] != 1:
                raise ValueError("this index of chunks is not known")
            level, used = head[5], struct.unpack_from("<H", head, 6)[0]
            raw = self.file.read(at + 24, used * (width + 8) + width)
            keys = [struct.unpack_from(f"<II{ndim}Q", raw, k * (width + 8)) for k in range(used + 1)]
            for k in range(used):
                child = struct.unpack_from("<Q", raw, k * (width + 8) + width)[0]
                first, beyond = keys[k][2], keys[k + 1][2]
                if first >= stop or (level and beyond + self.chunk[0] <= start) or (not level and first + self.chunk[0] <= start):
                    continue
                if level:
                    walk(child)
                else:
                    out.append((keys[k][2:], child, keys[k][0], keys[k][1]))

        walk(self.at)
        return out

    def decoded(self, chunk) -> np.ndarray:
        _, at, size, mask = chunk
        raw = self.file.read(at, size)
        for k in reversed(range(len(self.filters))):
            if mask >> k & 1:
                continue
            if self.filters[k] == CHECKSUM:
                raw = raw[:-4]
            elif self.filters[k] == DEFLATE:
                raw = zlib.decompress(raw)
            elif self.filters[k] == SHUFFLE:
                size = self.type.dtype.itemsize
                n = len(raw) // size
                raw = np.frombuffer(raw[: n * size], np.uint8).reshape(size, n).T.tobytes() + raw[n * size :]
            else:
                raise ValueError(f"filter {self.filters[k]} is not known")
        return np.frombuffer(raw, self.type.dtype, int(np.prod(self.chunk))).reshape(self.chunk)

    def rows(self, start: int, stop: int) -> np.ndarray:
        """Values from row start to stop."""
        if not self.shape:
            start, stop = 0, 1
        shape = (stop - start, *self.shape[1:])
        if self.layout == "compact":
            return np.frombuffer(self.at, self.type.dtype, int(np.prod(self.shape))).reshape(self.shape or (1,))[start:stop]
        if self.layout == "contiguous":
            size = self.row_bytes
            raw = self.file.read(self.at + start * size, (stop - start) * size) if self.at != NONE else bytes((stop - start) * size)
            return np.frombuffer(raw, self.type.dtype).reshape(shape)
        out = np.zeros(shape, self.type.dtype)
        for chunk in self.chunks(start, stop):
            part, offsets = self.decoded(chunk), chunk[0]
            low = max(offsets[0], start)
            high = min(offsets[0] + self.chunk[0], stop)
            target = (slice(low - start, high - start), *(slice(o, min(o + c, s)) for o, c, s in zip(offsets[1:], self.chunk[1:], self.shape[1:])))
            source = (slice(low - offsets[0], high - offsets[0]), *(slice(0, t.stop - t.start) for t in target[1:]))
            out[target] = part[source]
        return out


class File:
    """An open file; only pages that are asked for are read, and the last PAGES of them are kept."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.handle = fs.open_input_file(path)
        self.pages: OrderedDict[int, bytes] = OrderedDict()
        self.heaps: dict[int, dict[int, tuple[int, int]]] = {}
        if self.read(0, 8) != SIGNATURE:
            raise ValueError(f"{uri} is not an HDF5 file")
        version = self.read(8, 1)[0]
        sizes = self.read(13, 2) if version < 2 else self.read(9, 2)
        if sizes != b"\x08\x08":
            raise ValueError("only addresses and lengths of 8 bytes are known")
        self.root = struct.unpack("<Q", self.read({0: 64, 1: 68}.get(version, 36), 8))[0]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()

    def read(self, at: int, n: int) -> bytes:
        if n > PAGE * 4:
            return self.handle.read_at(n, at)
        out = []
        for page in range(at // PAGE, (at + n - 1) // PAGE + 1 if n else at // PAGE):
            data = self.pages.pop(page, None)
            if data is None:
                data = self.handle.read_at(PAGE, page * PAGE)
                if len(self.pages) >= PAGES:
                    self.pages.popitem(last=False)
            self.pages[page] = data
            out.append(data[max(0, at - page * PAGE) : max(0, at + n - page * PAGE)])
        return b"".join(out)

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """(number, content) of all messages of an object's header."""
        out, head = [], self.read(at, 16)
        if head[:4] == b"OHDR":
            flags, here = head[5], at + 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.read(here, width), "little")
            blocks, skip = [(here + width, size)], 2 if flags & 4 else 0
            while blocks:
                here, size = blocks.pop(0)
                raw, k = self.read(here, size), 0
                while k + 4 + skip <= size:
                    kind, n = raw[k], struct.unpack_from("<H", raw, k + 1)[0]
                    body = raw[k + 4 + skip : k + 4 + skip + n]
                    if kind == CONTINUATION:
                        a, n_ = struct.unpack("<QQ", body)
                        blocks.append((a + 4, n_ - 8))
                    out.append((kind, body))
                    k += 4 + skip + n
            return out
        if head[0] != 1:
            raise ValueError("this version of object headers is not known")
        blocks = [(at + 16, struct.unpack_from("<I", head, 8)[0])]
        while blocks:
            here, size = blocks.pop(0)
            raw, k = self.read(here, size), 0
            while k + 8 <= size:
                kind, n = struct.unpack_from("<HH", raw, k)
                body = raw[k + 8 : k + 8 + n]
                if kind == CONTINUATION:
                    blocks.append(struct.unpack_from("<QQ", body))
                out.append((kind, body))
                k += 8 + n
        return out

    def links(self, at: int | None = None) -> dict[str, int]:
        """Names in a group and the addresses of their headers."""
        out = {}
        for kind, body in self.messages(self.root if at is None else at):
            if kind == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", body)
                names = struct.unpack_from("<Q", self.read(heap + 24, 8))[0]
                out |= self._symbols(tree, names)
            elif kind == LINK:
                flags, k = body[1], 2
                hard = not flags & 8 or body[k] == 0
                k += (flags >> 3 & 1) + (flags >> 2 & 1) * 8 + (flags >> 4 & 1)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                if hard:
                    out[body[k + width : k + width + n].decode()] = struct.unpack_from("<Q", body, k + width + n)[0]
            elif kind == LINK_INFO and struct.unpack_from("<Q", body, 2 + (body[1] & 1) * 8)[0] != NONE:
                raise ValueError("groups in fractal heaps are not known")
        return out

    def _symbols(self, at: int, names: int) -> dict[str, int]:
        out, head = {}, self.read(at, 24)
        if head[:4] == b"SNOD":
            for k in range(struct.unpack_from("<H", head, 6)[0]):
                name, header = struct.unpack("<QQ", self.read(at + 8 + 40 * k, 16))
                raw = b""
                while b"\0" not in raw:
                    raw += self.read(names + name + len(raw), 32)
                out[raw.split(b"\0")[0].decode()] = header
            return out
        for k in range(struct.unpack_from("<H", head, 6)[0]):
            out |= self._symbols(struct.unpack("<Q", self.read(at + 32 + 16 * k, 8))[0], names)
        return out

    def find(self, path: str) -> int | None:
        at = self.root
        for name in filter(None, path.split("/")):
            at = self.links(at).get(name)
            if at is None:
                return None
        return at

    def dataset(self, path: str) -> Dataset:
        at = self.find(path)
        if at is None:
            raise KeyError(path)
        parts = dict(reversed(self.messages(at)))
        if LAYOUT not in parts:
            raise KeyError(f"{path} is a group")
        space, layout = parts[DATASPACE], parts[LAYOUT]
        n, start = space[1], 8 if space[0] == 1 else 4
        shape = struct.unpack_from(f"<{n}Q", space, start)
        kind = _parse(parts[DATATYPE])[0]
        filters = _filters(parts[FILTERS]) if FILTERS in parts else []
        if layout[0] not in (3, 4):
            raise ValueError(f"layout version {layout[0]} is not known")
        if layout[1] == 0:
            size = struct.unpack_from("<H", layout, 2)[0]
            return Dataset(self, kind, shape, "compact", layout[4 : 4 + size])
        if layout[1] == 1:
            return Dataset(self, kind, shape, "contiguous", struct.unpack_from("<Q", layout, 2)[0])
        if layout[0] != 3:
            raise ValueError("this index of chunks is not known")
        chunk = struct.unpack_from(f"<{n}I", layout, 11)
        return Dataset(self, kind, shape, "chunked", struct.unpack_from("<Q", layout, 3)[0], chunk, filters)

    def heap(self, at: int) -> dict[int, tuple[int, int]]:
        """(address, bytes) by number of the objects in a global heap."""
        found = self.heaps.get(at)
        if found is None:
            if len(self.heaps) > 256:
                self.heaps.clear()
            size, found, k = struct.unpack("<Q", self.read(at + 8, 8))[0], {}, 16
            while k + 16 <= size:
                number, _, _, n = struct.unpack("<HHIQ", self.read(at + k, 16))
                if not number:
                    break
                found[number] = (at + k + 16, n)
                k += 16 + (n + 7) // 8 * 8
            self.heaps[at] = found
        return found

    def values(self, kind: Type, refs: np.ndarray) -> list[np.ndarray]:
        """Variable-length values behind references."""
        out = []
        for n, at, k in refs.tolist():
            if not n or at in (0, NONE):
                out.append(np.zeros(0, kind.base.dtype))
            else:
                start, _ = self.heap(at)[k]
                out.append(np.frombuffer(self.read(start, n * kind.base.dtype.itemsize), kind.base.dtype))
        return out

    def text(self, path: str) -> str:
        """A text that is a data set of one value."""
        own = self.dataset(path)
        raw = own.rows(0, 1).reshape(-1)[:1]
        data = self.values(own.type, raw)[0].tobytes() if own.type.kind == "vlen" else raw[0]
        return data.split(b"\0")[0].decode()


def _parse(raw: bytes, k: int = 0) -> tuple[Type, int]:
    """A type from its message, and where it ends."""
    kind, version, bits = raw[k] & 15, raw[k] >> 4, int.from_bytes(raw[k + 1 : k + 4], "little")
    size, k = struct.unpack_from("<I", raw, k + 4)[0], k + 8
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return typed(f"{order}{'i' if bits & 8 else 'u'}{size}"), k + 4
    if kind == 1:
        return typed(f"{order}f{size}"), k + 12
    if kind == 3:
        return typed(f"S{size}"), k
    if kind == 8:  # an enumeration: its base, then names and values
        base, k = _parse(raw, k)
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", k) + 1
            k = end if version == 3 else k + -(-(end - k) // 8) * 8
        return base, k + (bits & 0xFFFF) * base.dtype.itemsize
    if kind == 9:
        base, k = _parse(raw, k)
        return Type("vlen", VLEN, base, text=bool(bits & 15)), k
    if kind == 10:
        n, k = raw[k], k + (1 if version >= 3 else 4)
        shape = struct.unpack_from(f"<{n}I", raw, k)
        base, k = _parse(raw, k + 4 * n * (1 if version >= 3 else 2))
        return Type("array", np.dtype((base.dtype, shape)), base), k
    if kind == 6:
        names, offsets, kinds = [], [], []
        for _ in range(bits & 0xFFFF):
            end = raw.index(b"\0", k)
            names.append(raw[k:end].decode())
            k = end + 1 if version >= 3 else k + (end - k) // 8 * 8 + 8
            width = max(1, ((size - 1).bit_length() + 7) // 8) if version >= 3 else 4
            offsets.append(int.from_bytes(raw[k : k + width], "little"))
            k += width
            dims = ()
            if version == 1:
                dims, k = struct.unpack_from(f"<{raw[k]}I", raw, k + 12), k + 28
            own, k = _parse(raw, k)
            kinds.append(Type("array", np.dtype((own.dtype, dims)), own) if dims else own)
        dtype = np.dtype({"names": names, "formats": [t.dtype for t in kinds], "offsets": offsets, "itemsize": size})
        return Type("compound", dtype, members=tuple(zip(names, offsets, kinds))), k
    raise ValueError(f"data type {kind} is not known")


def _filters(raw: bytes) -> list[int]:
    out, k = [], 8 if raw[0] == 1 else 2
    for _ in range(raw[1]):
        number = struct.unpack_from("<H", raw, k)[0]
        named = raw[0] == 1 or number >= 256
        name = struct.unpack_from("<H", raw, k + 2)[0] if named else 0
        k += 4 if named else 2
        values = struct.unpack_from("<H", raw, k + 2)[0]
        k += 4 + (-(-name // 8) * 8 if raw[0] == 1 else name) + 4 * values + (4 * (values % 2) if raw[0] == 1 else 0)
        out.append(number)
    return out


# Writing


def _message(t: Type) -> bytes:
    size = t.dtype.itemsize
    if t.kind == "number" and t.dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 if t.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
    if t.kind == "number":
        exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[size]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)
    if t.kind == "string":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, size)
    if t.kind == "vlen":
        return struct.pack("<BBBBI", 0x19, int(t.text), 0, 0, 16) + _message(t.base)
    if t.kind == "array":
        shape = t.dtype.subdtype[1]
        return struct.pack(f"<BBBBIB3x{2 * len(shape)}I", 0x2A, 0, 0, 0, size, len(shape), *shape, *range(len(shape))) + _message(t.base)
    out = struct.pack("<BHBI", 0x26, len(t.members), 0, size)
    for name, offset, kind in t.members:
        raw = name.encode()
        out += raw + bytes(8 - len(raw) % 8) + struct.pack("<I", offset) + _message(kind)
    return out


class Builder:
    """A file in memory: values first, groups and the superblock at the end. `bytes()` gives the file."""

    def __init__(self):
        self.out = bytearray(96)
        self.tree: dict = {}
        self.heap_at, self.heap_items = 0, []

    def put(self, raw: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    def references(self, values: list[bytes], item: int) -> np.ndarray:
        """Values put into global heaps, as references."""
        out, k = np.zeros(len(values), VLEN), 0
        while k < len(values):
            body, first = bytearray(), k
            while k < len(values) and (len(body) + len(values[k]) <= HEAP or k == first) and k - first < 60_000:
                raw = values[k]
                body += struct.pack("<HHIQ", k - first + 1, 1, 0, len(raw)) + raw + bytes(-len(raw) % 8)
                k += 1
            size = max(4096, 16 + len(body) + 16)
            free = size - 16 - len(body)
            at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, size) + bytes(body) + struct.pack("<HHIQ", 0, 0, 0, free) + bytes(free - 16))
            out["n"][first:k] = [len(v) // item for v in values[first:k]]
            out["at"][first:k], out["k"][first:k] = at, np.arange(1, k - first + 1)
        return out

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, raw in messages:
            raw += bytes(-len(raw) % 8)
            body += struct.pack("<HHB3x", kind, len(raw), 0) + raw
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def dataset(self, path: str, data: np.ndarray, kind: Type | None = None, chunk: tuple[int, ...] | None = None, deflate: bool = False) -> None:
        kind = kind or typed(data.dtype)
        shape = data.shape
        space = struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)
        messages = [(DATASPACE, space), (DATATYPE, _message(kind))]
        if chunk:
            if deflate:
                messages.append((FILTERS, struct.pack("<BB6xHHHHI4xHHHHI4x", 1, 2, SHUFFLE, 0, 1, 1, kind.dtype.itemsize, DEFLATE, 0, 1, 1, 4)))
            at = self._chunked(data, chunk, kind.dtype.itemsize, deflate)
            layout = struct.pack(f"<BBBQ{len(chunk)}II", 3, 2, len(chunk) + 1, at, *chunk, kind.dtype.itemsize)
        else:
            raw = np.ascontiguousarray(data).tobytes()
            layout = struct.pack("<BBQQ", 3, 1, self.put(raw) if raw else NONE, len(raw))
        self._place(path, self.header([*messages, (0x05, struct.pack("<BBBB", 2, 2, 0, 0)), (LAYOUT, layout)]))

    def _chunked(self, data: np.ndarray, chunk: tuple[int, ...], item: int, deflate: bool, fan: int = 64) -> int:
        """Address of the chunks' index."""
        grid = [range(0, s, c) for s, c in zip(data.shape, chunk)]
        keys, entries = [], []
        for place in np.ndindex(*map(len, grid)):
            offsets = [g[p] for g, p in zip(grid, place)]
            part = np.zeros(chunk, data.dtype)
            cut = data[tuple(slice(o, o + c) for o, c in zip(offsets, chunk))]
            part[tuple(slice(0, n) for n in cut.shape)] = cut
            raw = part.tobytes()
            if deflate:
                raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, item).T.tobytes(), 4)
            keys.append((len(raw), offsets))
            entries.append(self.put(raw))
        end = (0, list(data.shape))
        pack = lambda key: struct.pack(f"<II{len(chunk)}QQ", key[0], 0, *key[1], 0)
        level = 0
        while True:
            nodes, firsts = [], []
            for k in range(0, max(1, len(entries)), fan):
                own, marks = entries[k : k + fan], [*keys[k : k + fan], keys[k + fan] if k + fan < len(keys) else end]
                body = b"".join(pack(m) + struct.pack("<Q", e) for m, e in zip(marks, own)) + pack(marks[-1])
                room = fan * 8 + (fan + 1) * len(pack(end))
                nodes.append(self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), NONE, NONE) + body + bytes(room - len(body))))
                firsts.append(marks[0])
            entries, keys, level = nodes, firsts, level + 1
            if len(nodes) == 1:
                return nodes[0]

    def _place(self, path: str, header: int) -> None:
        *groups, name = filter(None, path.split("/"))
        at = self.tree
        for g in groups:
            at = at.setdefault(g, {})
        at[name] = header

    def text(self, path: str, value: str) -> None:
        raw = value.encode() + b"\0"
        self.dataset(path, self.references([raw], 1), vlen("S1", text=True))

    def _group(self, members: dict) -> tuple[int, int, int]:
        """Addresses of header, index and names."""
        at = {n: self._group(m)[0] if isinstance(m, dict) else m for n, m in members.items()}
        names, places = bytearray(8), {}
        for n in sorted(at):
            places[n] = len(names)
            names += n.encode() + bytes(8 - len(n.encode()) % 8)
        free = len(names)
        names += struct.pack("<QQ", 1, 16)
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), free, data))
        nodes = []
        for k in range(0, max(1, len(at)), 8):
            own = sorted(at)[k : k + 8]
            raw = b"SNOD" + struct.pack("<BxH", 1, len(own)) + b"".join(struct.pack("<QQI4x16x", places[n], at[n], 0) for n in own)
            nodes.append((self.put(raw + bytes(8 + 8 * 40 - len(raw))), places[own[-1]] if own else 0))
        if len(nodes) > 32:
            raise ValueError("more than 256 names in a group")
        raw = b"TREE" + struct.pack("<BBHQQQ", 0, 0, len(nodes), NONE, NONE, 0) + b"".join(struct.pack("<QQ", a, last) for a, last in nodes)
        tree = self.put(raw + bytes(24 + 65 * 8 - len(raw)))
        return self.header([(SYMBOLS, struct.pack("<QQ", tree, heap))]), tree, heap

    def bytes(self) -> bytes:
        header, tree, heap = self._group(self.tree)
        end = len(self.out)
        self.out[:96] = SIGNATURE + struct.pack("<BBBxBBBxHHIQQQQQQI4xQQ", 0, 0, 0, 0, 8, 8, 4, 16, 0, 0, NONE, end, NONE, 0, header, 1, tree, heap)
        return bytes(self.out)
