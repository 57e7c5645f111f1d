"""Small HDF5 files after the public format description, in an old and a new layout, for tests of the reader."""

import struct
import zlib

import numpy as np

NOWHERE = (1 << 64) - 1
pad8 = lambda b: b + b"\0" * (-len(b) % 8)


class Writer:
    """``new`` files have superblock 2, object headers 2 and link messages (or dense links); old ones superblock 0, object headers 1
    and symbol tables."""

    def __init__(self, new=False, dense=False):
        self.new, self.dense = new, dense
        self.raw = bytearray(b"\0" * (48 if new else 96))

    def put(self, content):
        self.raw += b"\0" * (-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += content
        return at

    # --- messages

    def space(self, shape):
        head = struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) if self.new else struct.pack("<BBB5x", 1, len(shape), 0)
        return head + b"".join(struct.pack("<Q", n) for n in shape)

    def type(self, dtype):
        if dtype == "text":
            return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
        if dtype == "refs":
            return struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
        if dtype == "compound":
            return struct.pack("<BBBBI", 0x16, 1, 0, 0, 8)
        d = np.dtype(dtype)
        order = d.byteorder == ">"
        if d.kind == "f":
            n = d.itemsize
            bits = (31, 23, 8, 0, 23, 127) if n == 4 else (63, 52, 11, 0, 52, 1023)
            return struct.pack("<BBBBI", 0x11, 0x20 | order, bits[0], 0, n) + struct.pack("<HHBBBBI", 0, 8 * n, *bits[1:5], bits[5])
        if d.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, d.itemsize)
        return struct.pack("<BBBBI", 0x10, order | (8 if d.kind == "i" else 0), 0, 0, d.itemsize) + struct.pack("<HH", 0, 8 * d.itemsize)

    def heap(self, contents):
        body = b"".join(struct.pack("<HH4xQ", i, 1, len(c)) + pad8(c) for i, c in enumerate(contents, 1))
        size = 16 + len(body) + 16
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, size) + body + b"\0" * 16)
        return [struct.pack("<IQI", len(c), at, i) for i, c in enumerate(contents, 1)]

    def attribute(self, name, value):
        if isinstance(value, str):
            kind, shape, data = ("text", (), self.heap([value.encode()])[0]) if self.new else (f"S{len(value)}", (), value.encode())
        elif isinstance(value, list) and isinstance(value[0], int) and name == "DIMENSION_LIST":
            kind, shape = "refs", (len(value),)
            data = b"".join(struct.pack("<IQI", 1, *struct.unpack("<QI", h[4:])) for h in self.heap([struct.pack("<Q", v) for v in value]))
        else:
            a = np.atleast_1d(np.asarray(value))
            kind, shape, data = a.dtype.str, (len(a),), a.tobytes()
        n, t, s = name.encode() + b"\0", self.type(kind), self.space(shape)
        if self.new:
            return 0x0C, struct.pack("<BBHHHB", 3, 0, len(n), len(t), len(s), 0) + n + t + s + data
        return 0x0C, struct.pack("<BxHHH", 1, len(n), len(t), len(s)) + pad8(n) + pad8(t) + pad8(s) + data

    def header(self, messages, split=False):
        if self.new:
            encode = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
            if split:  # the second half in a continuation
                rest = encode(messages[1:])
                more = self.put(b"OCHK" + rest + b"\0" * 4)
                messages = [messages[0], (0x10, struct.pack("<QQ", more, len(rest) + 8))]
            body = encode(messages)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)
        encode = lambda ms: b"".join(struct.pack("<HHB3x", k, len(pad8(d)), 0) + pad8(d) for k, d in ms)
        n = len(messages) + split
        if split:
            rest = encode(messages[1:])
            messages = [messages[0], (0x10, struct.pack("<QQ", self.put(rest), len(rest)))]
        body = encode(messages)
        return self.put(struct.pack("<BxHII4x", 1, n, 1, len(body)) + body)

    # --- objects

    def dataset(self, values, attrs=None, chunk=None, filters=(), kind=None, fill=None, compact=False, skip=()):
        a = np.asarray(values)
        messages = [(0x01, self.space(a.shape)), (0x03, self.type(kind or a.dtype.str))]
        if fill is not None:
            value = np.array(fill, a.dtype).tobytes()
            messages.append((0x05, (struct.pack("<BBI", 3, 0x20, len(value)) if self.new else struct.pack("<BBBBI", 2, 2, 2, 1, len(value))) + value))
        if filters:
            if self.new:
                messages.append((0x0B, struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHHI", f, 0, 1, 1) for f in filters)))
            else:
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHI4x", f, 0, 0, 1, 1) for f in filters)))

        def filtered(block):
            data = block.tobytes()
            for f in filters:
                data = zlib.compress(data) if f == 1 else np.frombuffer(data, np.uint8).reshape(-1, a.itemsize).T.tobytes() if f == 2 else data + b"abcd"
            return data

        if chunk is None and not compact:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes)))
        elif compact:
            messages.append((0x08, struct.pack("<BBH", 3, 0, a.nbytes) + a.tobytes()))
        elif chunk == "single":
            data = filtered(a)
            info = struct.pack("<QI", len(data), 0) if filters else b""
            messages.append((0x08, struct.pack("<BBBBB", 4, 2, 2 if filters else 0, a.ndim + 1, 4) + struct.pack(f"<{a.ndim + 1}I", *a.shape, a.itemsize) + b"\x01" + info + struct.pack("<Q", self.put(data))))
        else:
            entries = []
            for begin in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunk, strict=True))):
                at = tuple(b * c for b, c in zip(begin, chunk, strict=True))
                if at in skip:
                    continue
                block = np.zeros(chunk, a.dtype)
                part = a[tuple(slice(b, b + c) for b, c in zip(at, chunk, strict=True))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                data = filtered(block)
                entries.append((struct.pack("<II", len(data), 0) + struct.pack(f"<{a.ndim + 1}Q", *at, 0), self.put(data)))
            last = struct.pack("<II", 0, 0) + struct.pack(f"<{a.ndim + 1}Q", *a.shape, 0)
            leaf = lambda part: self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", p) for k, p in part) + last)
            half = len(entries) // 2
            leaves = [(entries[0][0], leaf(entries[:half])), (entries[half][0], leaf(entries[half:]))] if half else [(entries[0][0], leaf(entries))]
            top = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", p) for k, p in leaves) + last)
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, a.ndim + 1, top) + struct.pack(f"<{a.ndim + 1}I", *chunk, a.itemsize)))
        messages += [self.attribute(k, v) for k, v in (attrs or {}).items()]
        return self.header(messages, split=len(messages) > 4)

    def group(self, members, attrs=None):
        extra = [self.attribute(k, v) for k, v in (attrs or {}).items()]
        if not self.new:
            names, offsets = b"\0" * 8, []
            for n in sorted(members):
                offsets.append((len(names), members[n]))
                names += pad8(n.encode() + b"\0")
            heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(names)))
            node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(offsets)) + b"".join(struct.pack("<QQI4x16x", o, a, 0) for o, a in offsets))
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, offsets[-1][0] if offsets else 0))
            return self.header([(0x11, struct.pack("<QQ", tree, heap)), *extra])
        links = [struct.pack("<BBB", 1, 0, len(n.encode())) + n.encode() + struct.pack("<Q", a) for n, a in members.items()]
        if not self.dense:
            return self.header([*((0x06, b) for b in links), *extra])
        # dense: the links in one direct block of a fractal heap, found by a tree of one leaf
        start, offset, ids = 4 + 1 + 8 + 4, 0, []
        block = b""
        for link in links:
            ids.append(struct.pack("<BIH", 0, start + len(block), len(link)))
            block += link
        direct = self.put(b"FHDB" + struct.pack("<BQI", 0, 0, offset) + block + b"\0" * 64)
        heap = self.put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + struct.pack("<QQQQ", 0, NOWHERE, 0, NOWHERE) + struct.pack("<8Q", *[0] * 8) + struct.pack("<HQQHHQH", 4, 512, 65536, 32, 1, direct, 0) + b"\0" * 4)
        leaf = self.put(b"BTLF" + struct.pack("<BB", 0, 5) + b"".join(struct.pack("<I", i) + d for i, d in enumerate(ids)) + b"\0" * 4)
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, 512, 11, 0, 100, 40, leaf, len(ids), len(ids)) + b"\0" * 4)
        return self.header([(0x02, struct.pack("<BBQQ", 0, 0, heap, tree)), *extra])

    def finish(self, root):
        if self.new:
            self.raw[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.raw), root) + b"\0" * 4
        else:
            self.raw[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.raw), NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
        return bytes(self.raw)


def cube(new=False, dense=False, extra=None):
    """A NetCDF-4 like cube (time 2, lat 2, lon 3) with dimension scales."""
    w = Writer(new, dense)
    scale = lambda values, units: w.dataset(np.array(values, float), {"CLASS": "DIMENSION_SCALE", "NAME": "x", "units": units})
    time, lat, lon = scale([0, 1], "days since 2000-01-01"), scale([10, 20], "degrees_north"), scale([0, 1, 2], "degrees_east")
    values = np.arange(12.0, dtype="<f4").reshape(2, 2, 3)
    values[1, 1, 2] = -9999
    sm = w.dataset(values, {"_FillValue": np.float32(-9999), "units": "m3 m-3", "DIMENSION_LIST": [time, lat, lon]}, chunk=(1, 2, 2), filters=(2, 1, 3), fill=-9999)
    return w.finish(w.group({"time": time, "lat": lat, "lon": lon, "sm": sm, **({k: f(w) for k, f in (extra or {}).items()})}, {"title": "a cube"}))
