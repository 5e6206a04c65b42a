"""Text of PDF files: a small reader of page trees, content streams and character maps, after the published format.

It knows Flate-coded and plain streams, object streams, and fonts with a ToUnicode map; other fonts' bytes are taken as Latin-1.
Encrypted files are an error.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()%]*|[^\s/<>\[\]()%]+|\(|%[^\r\n]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in TJ, in thousandths of the font size, that stands for a blank.
GAP = 200


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s", data):
            raise ValueError("encrypted")
        self.maps: dict[bytes, CharacterMap | None] = {}
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        inside = stream_of(body)
        first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
        heads = list(map(int, inside[:first].split()))[: 2 * n]
        places = sorted(zip(heads[1::2], heads[::2], strict=True))
        for (at, number), end in zip(places, [*(p for p, _ in places[1:]), len(inside) - first], strict=True):
            self.objects.setdefault(number, inside[first + at : first + end])

    def value(self, body: bytes, key: bytes) -> bytes:
        """The value of a key of a dictionary, a reference followed; empty where there is none."""
        m = re.search(rb"/%s(?![A-Za-z0-9])\s*" % key, body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref[1]), b"")
        return _balanced(rest)

    def pages(self) -> list[bytes]:
        """Page dictionaries in order."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        tree = self.value(roots[-1], b"Pages") if roots else b""
        found: list[bytes] = []

        def walk(node: bytes, resources: bytes, depth: int) -> None:
            resources = self.value(node, b"Resources") or resources
            kids = self.value(node, b"Kids")
            if kids and depth < 64:
                for ref in _REF.finditer(kids):
                    walk(self.objects.get(int(ref[1]), b""), resources, depth + 1)
            elif re.search(rb"/Type\s*/Page\b", node):
                found.append(node + b"\n/Inherited " + resources)

        if tree:
            walk(tree, b"", 0)
        return found or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, CharacterMap]:
        """Character maps of a page's fonts, by font name."""
        resources = self.value(page, b"Resources") or self.value(page, b"Inherited")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            if number not in self.maps:
                cmap = self.value(self.objects.get(int(number), b""), b"ToUnicode")
                self.maps[number] = CharacterMap(stream_of(cmap)) if cmap else None
            if self.maps[number]:
                out[name] = self.maps[number]
        return out

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        refs = _REF.findall(m[1]) if m else []
        bodies = [self.objects.get(int(r), b"") for r in refs]
        if len(bodies) == 1 and b"stream" not in bodies[0]:  # a reference to an array
            bodies = [self.objects.get(int(r), b"") for r in _REF.findall(bodies[0])]
        return b"\n".join(map(stream_of, bodies))


def _balanced(text: bytes) -> bytes:
    """The dictionary, array or plain value at the start of text."""
    if text[:2] != b"<<" and text[:1] != b"[":
        return re.match(rb"[^/>\]]*", text)[0]
    depth = 0
    for m in re.finditer(rb"<<|>>|\[|\]", text):
        depth += 1 if m[0] in (b"<<", b"[") else -1
        if not depth:
            return text[: m.end()]
    return text


def stream_of(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    raw, head = body[m.end() :], body[: m.start()]
    raw = raw[: raw.rfind(b"endstream")] if b"endstream" in raw else raw
    return zlib.decompressobj().decompress(raw) if b"/FlateDecode" in head else raw


class CharacterMap:
    """Codes to UTF-16 units, from the bfchar and bfrange parts of a ToUnicode map; ranges are kept as such."""

    def __init__(self, cmap: bytes):
        wide = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode())
        self.single: dict[bytes, bytes] = {}
        self.ranges: list[tuple[int, int, int, bytes]] = []
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>", part):
                self.single[wide(code)] = wide(to)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
                size, start = len(low) // 2, int(low, 16)
                for i, to in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)):
                    self.single[(start + i).to_bytes(size, "big")] = wide(to)
                if one:
                    self.ranges.append((size, start, int(high, 16), wide(one)))
        self.size = max([*map(len, self.single), *(r[0] for r in self.ranges)], default=1)

    def units(self, code: bytes) -> bytes:
        if code not in self.single:
            value = int.from_bytes(code, "big")
            found = next((r for r in self.ranges if r[0] == len(code) and r[1] <= value <= r[2]), None)
            self.single[code] = (int.from_bytes(found[3], "big") + value - found[1]).to_bytes(len(found[3]), "big") if found else b""
        return self.single[code]

    def text(self, raw: bytes) -> str:
        return b"".join(self.units(raw[i : i + self.size]) for i in range(0, len(raw), self.size)).decode("utf-16-be", "replace")


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _decoded(raw: bytes, codes: CharacterMap | None) -> str:
    return codes.text(raw) if codes else raw.decode("latin-1")


def shown(content: bytes, fonts: dict[bytes, CharacterMap]) -> list[str]:
    """The strings that a content stream shows."""
    out, stack, array, codes = [], [], None, None
    for m in _TOKEN.finditer(_nested(content)):
        token = m[0]
        if token == b"[":
            array = []
        elif token == b"]":
            stack, array = [array], None
        elif token[:1] in b"(<" and token not in (b"<<", b"("):
            (stack if array is None else array).append(_literal(token))
        elif array is not None:
            if re.fullmatch(rb"[-+.\d]+", token):
                array.append(float(token))
        elif token[:1] == b"/":
            stack = [token[1:]]
        elif token == b"Tf":
            codes = next((fonts[x] for x in stack if isinstance(x, bytes) and x in fonts), None)
            stack = []
        elif token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            out.append(_decoded(stack.pop(), codes))
            stack = []
        elif token == b"TJ" and stack and isinstance(stack[-1], list):
            out.append("".join(_decoded(x, codes) if isinstance(x, bytes) else " " * (x < -GAP) for x in stack.pop()))
            stack = []
        elif re.fullmatch(rb"[A-Za-z*]+", token):
            stack = []
    return out


def _nested(content: bytes) -> bytes:
    """content with the parentheses inside of its strings escaped."""
    if b"(" not in content:
        return content
    out, depth, i = bytearray(), 0, 0
    while i < len(content):
        c = content[i : i + 1]
        if c == b"\\" and depth:
            out += content[i : i + 2]
            i += 2
            continue
        if c == b"(":
            out += b"\\(" if depth else c
            depth += 1
        elif c == b")" and depth:
            depth -= 1
            out += b"\\)" if depth else c
        else:
            out += c
        i += 1
    return bytes(out)


def read_pages(data: bytes) -> list[list[str]]:
    """The strings of each page of a PDF file: the default reader of documents.parse_documents()."""
    pdf = Pdf(data)
    return [shown(pdf.content(p), pdf.fonts(p)) for p in pdf.pages()]
