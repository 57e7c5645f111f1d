"""HDF5 and NetCDF-4 files after the public format description, read without a library.

Superblocks 0 to 3, object headers 1 and 2, groups as symbol tables, link messages or dense links, attributes in headers or
dense, numbers and text, compact, contiguous and chunked data (version 1 trees and single chunks), and the filters deflate,
shuffle and fletcher32.  Variables of groups are called by their path, and by their own name where it is the only one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from loamline.session import EngineError

MAGIC = b"\x89HDF\r\n\x1a\n"
#: Fixed values of the format: message types, and filters by number.
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS, ATTRIBUTE_INFO = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
DEFLATE, SHUFFLE, FLETCHER32 = 1, 2, 3
DENSE_LINKS, DENSE_ATTRIBUTES = 5, 8
BARE_DIMENSION = "This is a netCDF dimension but not a netCDF variable"


class _At:
    """Little-endian numbers from a place on."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise EngineError("the HDF5 file ends too early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def signed(self, mark: bytes) -> None:
        if self.take(4) != mark:
            raise EngineError(f"no {mark.decode()} where one should be")


@dataclass
class H5Type:
    """A type as numpy sees it; ``text`` for strings, ``heap`` for values of varying length, ``parts`` for compounds."""

    numpy: np.dtype
    text: bool = False
    heap: H5Type | None = None
    compound: bool = False


@dataclass
class H5Variable:
    """A dataset: its dimensions by name, attributes, shape, type, and what its data lie in."""

    name: str
    dims: list[str]
    attrs: dict
    shape: tuple[int, ...]
    type: H5Type
    address: int
    layout: tuple = ()
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    fill: bytes | None = None


class H5File:
    """A parsed file with access to its arrays, like a classic one."""

    def __init__(self, raw: bytes):
        start = next((at for at in (0, *(512 << k for k in range(12))) if raw[at : at + 8] == MAGIC), None)
        if start is None:
            raise EngineError("no HDF5 file")
        self.raw = raw[start:] if start else raw
        self.variables: dict[str, H5Variable] = {}
        self.attrs: dict = {}
        self.groups: list[str] = []
        self.types: list[str] = []
        self._names: dict[int, str] = {}
        self._heaps: dict[int, dict[int, bytes]] = {}
        version = self.raw[8]
        if version in (0, 1):
            self.o, self.l = self.raw[13], self.raw[14]
            r = _At(self.raw, 24 + 4 * version + 4 * self.o + self.o)
        elif version in (2, 3):
            self.o, self.l = self.raw[9], self.raw[10]
            r = _At(self.raw, 12 + 3 * self.o)
        else:
            raise EngineError(f"HDF5 superblock {version} is not known")
        self._walk(r.number(self.o), "")
        short: dict[str, list[str]] = {}
        for path in self.variables:
            short.setdefault(path.rsplit("/", 1)[-1], []).append(path)
        self.dims = [(n, v.shape[0]) for n, v in self.variables.items() if v.attrs.get("CLASS") == "DIMENSION_SCALE" and len(v.shape) == 1]
        for v in self.variables.values():
            v.dims = self._dims(v)
        bare = [n for n, v in self.variables.items() if str(v.attrs.get("NAME", "")).startswith(BARE_DIMENSION)]
        for name in bare:
            del self.variables[name]
            short.pop(name.rsplit("/", 1)[-1], None)
        for name, paths in short.items():
            if len(paths) == 1:
                self.variables.setdefault(name, self.variables[paths[0]])
        if not self.dims:
            self.dims = [(d, n) for v in self.variables.values() for d, n in zip(v.dims, v.shape, strict=True)]
        self.dims = list(dict(self.dims).items())
        for v in self.variables.values():  # bookkeeping of the dimensions is no attribute of the data
            v.attrs = {k: a for k, a in v.attrs.items() if k not in ("CLASS", "NAME", "DIMENSION_LIST", "REFERENCE_LIST", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_NCProperties")}

    def dim_names(self, name: str) -> list[str]:
        return self.variables[name].dims

    # --- objects

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object header, continuations included."""
        if self.raw[address : address + 4] == b"OHDR":
            r = _At(self.raw, address + 5)
            flags = r.number(1)
            r.at += 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            todo, head, out = [(0, 0)], 4 + 2 * bool(flags & 4), []
            size = r.number(1 << (flags & 3))
            todo = [(r.at, size)]
            while todo:
                at, size = todo.pop(0)
                end = at + size
                while at + head <= end:
                    r = _At(self.raw, at)
                    kind, n = r.number(1), r.number(2)
                    r.at = at + head
                    data = r.take(n)
                    at = r.at
                    if kind == CONTINUED:
                        c = _At(data)
                        where, length = c.number(self.o), c.number(self.l)
                        _At(self.raw, where).signed(b"OCHK")
                        todo.append((where + 4, length - 8))
                    elif kind:
                        out.append((kind, data))
            return out
        r = _At(self.raw, address)
        if r.number(1) != 1:
            raise EngineError("an object header is of no known version")
        r.at += 1
        left, _, size = r.number(2), r.number(4), r.number(4)
        todo, out = [(address + 16, size)], []
        while todo and left:
            at, size = todo.pop(0)
            end = at + size
            while at + 8 <= end and left:
                r = _At(self.raw, at)
                kind, n = r.number(2), r.number(2)
                r.at += 4
                data, at, left = r.take(n), at + 8 + n, left - 1
                if kind == CONTINUED:
                    c = _At(data)
                    todo.append((c.number(self.o), c.number(self.l)))
                elif kind:
                    out.append((kind, data))
        return out

    def _walk(self, root: int, _: str) -> None:
        todo, seen = [(root, "")], set()
        while todo:
            address, path = todo.pop()
            if address in seen or address == (1 << 8 * self.o) - 1:
                continue
            seen.add(address)
            self._names[address] = path
            messages = self._messages(address)
            kinds = {k for k, _ in messages}
            attrs = self._attributes(messages)
            if DATASPACE in kinds and LAYOUT in kinds:
                self._dataset(address, path, messages, attrs)
            elif DATATYPE in kinds:
                self.types.append(path)
            else:
                self.attrs |= attrs if not path else {}
                self.groups += [path] * bool(path)
                todo += [(a, f"{path}/{n}" if path else n) for n, a in self._links(messages)]

    def _links(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        for kind, data in messages:
            r = _At(data)
            if kind == SYMBOLS:
                tree, heap = r.number(self.o), r.number(self.o)
                h = _At(self.raw, heap)
                h.signed(b"HEAP")
                h.at += 4 + 2 * self.l
                names = h.number(self.o)
                for node in self._leaves(tree, 0, self.l):
                    s = _At(self.raw, node[1])
                    s.signed(b"SNOD")
                    s.at += 2
                    for _ in range(s.number(2)):
                        name, where = s.number(self.o), s.number(self.o)
                        s.at += 24
                        yield self._text(names + name), where
            elif kind == LINK:
                yield from self._link(data)
            elif kind == LINK_INFO:
                flags = _At(data, 1).number(1)
                r.at = 2 + 8 * (flags & 1)
                heap, tree = r.number(self.o), r.number(self.o)
                for found in self._dense(heap, tree, DENSE_LINKS):
                    yield from self._link(found)

    def _link(self, data: bytes) -> Iterator[tuple[str, int]]:
        r = _At(data, 1)
        flags = r.number(1)
        kind = r.number(1) if flags & 8 else 0
        r.at += 8 * bool(flags & 4) + bool(flags & 16)
        name = r.take(r.number(1 << (flags & 3))).decode("utf-8", "replace")
        if kind == 0:  # other links lead out of the file or are names only
            yield name, r.number(self.o)

    def _text(self, at: int) -> str:
        return self.raw[at : self.raw.index(b"\0", at)].decode("utf-8", "replace")

    def _leaves(self, address: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, address) of the leaves of a version 1 tree."""
        todo = [address]
        while todo:
            at = todo.pop(0)
            if at == (1 << 8 * self.o) - 1:
                continue
            r = _At(self.raw, at)
            r.signed(b"TREE")
            if r.number(1) != kind:
                raise EngineError("a tree is of another kind than expected")
            level, n = r.number(1), r.number(2)
            r.at += 2 * self.o
            children = [(r.take(key), r.number(self.o)) for _ in range(n)]
            if level:
                todo += [a for _, a in children]
            else:
                yield from children

    # --- dense storage

    def _dense(self, heap: int, tree: int, kind: int) -> Iterator[bytes]:
        """Objects of a fractal heap by the records of a version 2 tree."""
        if heap == (1 << 8 * self.o) - 1:
            return
        h = _At(self.raw, heap)
        h.signed(b"FRHP")
        h.at += 1
        id_size, filtered = h.number(2), h.number(2)
        if filtered:
            raise EngineError("filtered heaps are not supported")
        h.at += 1
        largest = h.number(4)
        h.at += 2 * (self.l + self.o) + 8 * self.l
        width, first, most, bits = h.number(2), h.number(self.l), h.number(self.l), h.number(2)
        h.at += 2
        root, rows = h.number(self.o), h.number(2)
        offset_size = -(-bits // 8)
        length_size = min((most.bit_length() + 6) // 8, (largest.bit_length() - 1) // 8 + 1)
        for record in self._records(tree, kind):
            where = record[4 : 4 + id_size] if kind == DENSE_LINKS else record[:id_size]
            r = _At(where)
            if r.number(1) >> 4 & 3:
                raise EngineError("huge and tiny heap objects are not supported")
            offset, n = r.number(offset_size), r.number(length_size)
            at = self._block(root, rows, width, first, most, offset, offset_size)
            yield self.raw[at : at + n]

    def _block(self, address: int, rows: int, width: int, first: int, most: int, offset: int, offset_size: int) -> int:
        """Where an offset of a heap lies in the file."""
        if not rows:
            return address + offset
        start = 0
        pointer = address + 5 + self.o + offset_size
        for row in range(rows):
            size = first << max(row - 1, 0)
            for _ in range(width):
                child = _At(self.raw, pointer).number(self.o)
                pointer += self.o
                if start <= offset < start + size:
                    if size <= most:
                        return child + offset - start
                    inner = (size // (first * width)).bit_length()
                    return self._block(child, inner, width, first, most, offset - start, offset_size)
                start += size
        raise EngineError("a heap offset lies outside its blocks")

    def _records(self, tree: int, kind: int) -> Iterator[bytes]:
        r = _At(self.raw, tree)
        r.signed(b"BTHD")
        r.at += 1
        if r.number(1) not in (kind, kind + 1):
            raise EngineError("a tree is of another kind than expected")
        node_size, record, depth = r.number(4), r.number(2), r.number(2)
        r.at += 2
        root, n = r.number(self.o), r.number(2)
        if root == (1 << 8 * self.o) - 1:
            return
        # the greatest numbers of records decide how wide their counts are
        leaf = (node_size - 10) // record
        most, total, widths = [leaf], [leaf], [(-(-leaf.bit_length() // 8), 0)]
        for level in range(1, depth + 1):
            pointer = self.o + widths[-1][0] + (-(-total[-1].bit_length() // 8) if level > 1 else 0)
            most.append((node_size - 10 - pointer) // (record + pointer))
            total.append(most[-1] + (most[-1] + 1) * total[-1])
            widths.append((-(-most[-1].bit_length() // 8), 0))
        todo = [(root, n, depth)]
        while todo:
            at, n, level = todo.pop(0)
            r = _At(self.raw, at)
            r.signed(b"BTIN" if level else b"BTLF")
            r.at += 2
            yield from [r.take(record) for _ in range(n)]
            if level:
                for _ in range(n + 1):
                    child, count = r.number(self.o), r.number(widths[level - 1][0])
                    r.at += -(-total[level - 1].bit_length() // 8) if level > 1 else 0
                    todo.append((child, count, level - 1))

    # --- attributes and types

    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict:
        out = {}
        found = [d for k, d in messages if k == ATTRIBUTE]
        for kind, data in messages:
            if kind == ATTRIBUTE_INFO:
                r = _At(data, 1)
                r.at = 2 + 2 * (r.number(1) & 1)
                found += self._dense(r.number(self.o), r.number(self.o), DENSE_ATTRIBUTES)
        for data in found:
            name, value = self._attribute(data)
            out[name] = value
        return out

    def _attribute(self, data: bytes) -> tuple[str, object]:
        r = _At(data)
        version = r.number(1)
        r.at += 1
        sizes = [r.number(2) for _ in range(3)]
        r.at += version == 3
        parts = []
        for n in sizes:
            parts.append(r.take(n))
            r.at += -n % 8 if version == 1 else 0
        kind, shape = self._type(parts[1]), self._shape(parts[2])
        values = self._values(data[r.at :], kind, int(np.prod(shape, dtype=np.int64)))
        name = parts[0].split(b"\0")[0].decode("utf-8", "replace")
        if isinstance(values, list):
            return name, values[0] if len(values) == 1 and name != "DIMENSION_LIST" else values
        return name, values[0].item() if len(values) == 1 else values.tolist()

    def _shape(self, data: bytes) -> tuple[int, ...]:
        rank = data[1]
        if data[0] == 2 and data[3] == 2:  # no value at all
            return (0,)
        r = _At(data, 8 if data[0] == 1 else 4)
        return tuple(r.number(self.l) for _ in range(rank))

    def _type(self, data: bytes) -> H5Type:
        kind, bits, size = data[0] & 15, data[1], int.from_bytes(data[4:8], "little")
        order = ">" if bits & 1 else "<"
        if kind == 0:
            return H5Type(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
        if kind == 1:
            return H5Type(np.dtype(f"{order}f{size}"))
        if kind == 3:
            return H5Type(np.dtype(f"S{size}"), text=True)
        if kind == 8:  # an enumeration is its numbers
            return self._type(data[8:])
        if kind == 9:
            return H5Type(np.dtype(f"V{size}"), text=(bits & 15) == 1, heap=self._type(data[8:]))
        if kind == 7:
            return H5Type(np.dtype(f"<u{size}") if size in (1, 2, 4, 8) else np.dtype(f"V{size}"))
        return H5Type(np.dtype(f"V{size}"), compound=True)

    def _values(self, data: bytes, kind: H5Type, n: int) -> np.ndarray | list:
        """Numbers as an array; text, and values of varying length, as a list."""
        found = np.frombuffer(data, kind.numpy, n)
        if kind.heap is not None:
            out = []
            for item in found:
                r = _At(item.tobytes())
                length, where, index = r.number(4), r.number(self.o), r.number(4)
                content = self._heap(where).get(index, b"") if length else b""
                out.append(content[: length * kind.heap.numpy.itemsize].split(b"\0")[0].decode("utf-8", "replace") if kind.text else np.frombuffer(content, kind.heap.numpy, length).tolist())
            return out
        if kind.text:
            return [v.split(b"\0")[0].decode("utf-8", "replace").rstrip() for v in found.tolist()]
        return found

    def _heap(self, address: int) -> dict[int, bytes]:
        """The objects of a global heap by number."""
        if address not in self._heaps:
            r = _At(self.raw, address)
            r.signed(b"GCOL")
            r.at += 4
            end, objects = address + r.number(self.l), {}
            while r.at + 8 + self.l <= end:
                index = r.number(2)
                r.at += 6
                n = r.number(self.l)
                if not index:
                    break
                objects[index] = r.take(n)
                r.at += -n % 8
            self._heaps[address] = objects
        return self._heaps[address]

    # --- data

    def _dataset(self, address: int, path: str, messages: list[tuple[int, bytes]], attrs: dict) -> None:
        by = dict(reversed(messages))
        v = H5Variable(path, [], attrs, self._shape(by[DATASPACE]), self._type(by[DATATYPE]), address)
        if FILTERS in by:
            v.filters = self._filters(by[FILTERS])
        if FILL in by:
            r = _At(by[FILL])
            version = r.number(1)
            r.at += 2 if version < 3 else 0
            flags = r.number(1)
            if (flags & 0x20) if version == 3 else flags:
                v.fill = r.take(r.number(4)) or None
        r = _At(by[LAYOUT])
        version, kind = r.number(1), r.number(1)
        if version not in (3, 4):
            raise EngineError(f"{path}: data layout {version} is not supported")
        if kind == 0:
            v.layout = ("whole", r.take(r.number(2)))
        elif kind == 1:
            v.layout = ("at", r.number(self.o), r.number(self.l))
        elif kind == 2 and version == 3:
            rank = r.number(1)
            tree = r.number(self.o)
            v.layout = ("tree", tree, tuple(r.number(4) for _ in range(rank))[:-1])
        elif kind == 2:
            flags, rank, width = r.number(1), r.number(1), r.number(1)
            chunk = tuple(r.number(width) for _ in range(rank))[:-1]
            index = r.number(1)
            if index != 1:
                raise EngineError(f"{path}: chunk index {index} is not supported")
            size, mask = (r.number(self.l), r.number(4)) if flags & 2 else (int(np.prod(chunk, dtype=np.int64)) * v.type.numpy.itemsize, 0)
            v.layout = ("chunk", r.number(self.o), size, mask, chunk)
        self.variables[path] = v

    def _filters(self, data: bytes) -> list[tuple[int, list[int]]]:
        r = _At(data)
        version, n = r.number(1), r.number(1)
        r.at += 6 if version == 1 else 0
        out = []
        for _ in range(n):
            number = r.number(2)
            name = r.number(2) if version == 1 or number >= 256 else 0
            r.at += 2
            values = r.number(2)
            r.at += name + (-name % 8 if version == 1 else 0)
            out.append((number, [r.number(4) for _ in range(values)]))
            r.at += 4 * (values % 2) if version == 1 else 0
        return out

    def _unfiltered(self, v: H5Variable, data: bytes, mask: int) -> bytes:
        for i, (number, _) in reversed(list(enumerate(v.filters))):
            if mask >> i & 1:
                continue
            if number == DEFLATE:
                data = zlib.decompress(data)
            elif number == SHUFFLE:
                size = v.type.numpy.itemsize
                whole = len(data) // size * size
                data = np.frombuffer(data[:whole], np.uint8).reshape(size, -1).T.tobytes() + data[whole:]
            elif number == FLETCHER32:
                data = data[:-4]
            else:
                raise EngineError(f"{v.name}: filter {number} is not supported")
        return data

    def array(self, name: str) -> np.ndarray:
        """Values of a variable; chunks that were never written hold the fill value."""
        v = self.variables[name]
        if v.type.compound:
            raise EngineError(f"{name} is of a compound type")
        if v.type.heap is not None:
            raise EngineError(f"{name} holds values of varying length")
        kind, n = v.type.numpy, int(np.prod(v.shape, dtype=np.int64))
        empty = np.frombuffer(v.fill, kind, 1)[0] if v.fill and len(v.fill) >= kind.itemsize else np.zeros(1, kind)[0]
        nowhere = (1 << 8 * self.o) - 1
        if v.layout[0] in ("whole", "at"):
            data = v.layout[1] if v.layout[0] == "whole" else b"" if v.layout[1] == nowhere else self.raw[v.layout[1] : v.layout[1] + v.layout[2]]
            return np.frombuffer(data, kind, n).reshape(v.shape) if data else np.full(v.shape, empty)
        out = np.full(v.shape, empty, kind)
        chunk = v.layout[-1]
        if v.layout[0] == "chunk":
            chunks = [(v.layout[2], v.layout[3], (0,) * len(chunk), v.layout[1])] if v.layout[1] != nowhere else []
        else:
            chunks = []
            for key, at in self._leaves(v.layout[1], 1, 8 + 8 * (len(chunk) + 1)):
                r = _At(key)
                chunks.append((r.number(4), r.number(4), tuple(r.number(8) for _ in chunk), at))
        for size, mask, begin, at in chunks:
            block = np.frombuffer(self._unfiltered(v, self.raw[at : at + size], mask), kind, int(np.prod(chunk, dtype=np.int64))).reshape(chunk)
            inside = tuple(slice(b, min(b + c, s)) for b, c, s in zip(begin, chunk, v.shape, strict=True))
            out[inside] = block[tuple(slice(0, i.stop - i.start) for i in inside)]
        return out

    def _dims(self, v: H5Variable) -> list[str]:
        """Names of the dimensions: by the list of scales, a scale its own, else by number."""
        if "DIMENSION_LIST" in v.attrs and len(v.attrs["DIMENSION_LIST"]) == len(v.shape):
            found = [self._names.get(refs[0]) if refs else None for refs in v.attrs["DIMENSION_LIST"]]
            return [f.rsplit("/", 1)[-1] if f else f"phony_dim_{i}" for i, f in enumerate(found)]
        if v.attrs.get("CLASS") == "DIMENSION_SCALE" and len(v.shape) == 1:
            return [v.name.rsplit("/", 1)[-1]]
        return [f"phony_dim_{i}" for i in range(len(v.shape))]


def parse(raw: bytes) -> H5File:
    """An HDF5 file from its bytes; what it can't read is refused."""
    try:
        return H5File(raw)
    except (IndexError, ValueError, KeyError, zlib.error) as e:
        raise e if isinstance(e, EngineError) else EngineError(f"the HDF5 file can't be read: {e}") from e
