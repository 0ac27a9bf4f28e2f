"""Object file and archive formats, read from their public specifications.

Pure functions on bytes: ELF (32 and 64 bit, either byte order), Mach-O (the
same), and `ar` archives with GNU or BSD long names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quarry.plans.rules import ELF_SECTION, MACHO_SECTION

# ---- fixed values: magic numbers ---------------------------------------------
ELF = b"\x7fELF"
MACHO = {b"\xfe\xed\xfa\xce": (">", 32), b"\xce\xfa\xed\xfe": ("<", 32), b"\xfe\xed\xfa\xcf": (">", 64), b"\xcf\xfa\xed\xfe": ("<", 64)}
ARCHIVE = b"!<arch>\n"
#: Date, owner, group and mode of a member that is written.
MEMBER = b"0           0     0     100644  "
#: As much of a file as ``sniff`` and ``is_relocatable`` look at.
HEAD_BYTES = 32
_ET_REL, _MH_OBJECT, _SHT_NOBITS = 1, 1, 8
_LC_SEGMENT, _LC_SYMTAB, _LC_SEGMENT_64 = 0x1, 0x2, 0x19
_SHT_SYMTAB, _SHT_RELA, _SHT_REL = 2, 4, 9
_N_STAB, _N_TYPE, _N_SECT = 0xE0, 0x0E, 0x0E
# ------------------------------------------------------------------------------


class FormatError(ValueError):
    """The bytes don't follow the format they claim."""


def sniff(data: bytes) -> str | None:
    """`elf`, `macho`, `archive`, or None for what isn't supported."""
    if data[:4] == ELF:
        return "elf"
    if data[:4] in MACHO:
        return "macho"
    return "archive" if data[:8] == ARCHIVE else None


def _unpack(layout: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from(layout, data, at)
    except struct.error as short:
        raise FormatError("file ends inside a header") from short


def _cut(data: bytes, at: int, size: int) -> bytes:
    if at + size > len(data):
        raise FormatError("section lies beyond the end of the file")
    return data[at : at + size]


def _elf_heads(data: bytes) -> tuple[bool, str, list[tuple]]:
    """Whether an ELF file is a 64-bit one, its byte order, its section headers."""
    wide, order = data[4:5] == b"\x02", "<" if data[5:6] == b"\x01" else ">"
    shoff = _unpack(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
    entry, count, names = _unpack(order + "3H", data, 58 if wide else 46)
    layout = order + ("IIQQQQIIQQ" if wide else "10I")
    heads = [_unpack(layout, data, shoff + k * entry) for k in range(count)] if shoff else []
    if heads and names >= len(heads):
        raise FormatError("no section name table")
    return wide, order, [(*h, _string(_cut(data, heads[names][4], heads[names][5]), h[0])) for h in heads]


def _string(table: bytes, at: int) -> str:
    """The string at a place in a table of strings that end in zero bytes."""
    end = table.find(b"\0", at)
    return table[at : end if end >= 0 else len(table)].decode("utf-8", "replace")


def _elf_sections(data: bytes) -> Iterator[tuple[str, bytes]]:
    for h in _elf_heads(data)[2][1:]:
        yield h[-1], b"" if h[1] == _SHT_NOBITS else _cut(data, h[4], h[5])


def _elf_symbols(data: bytes) -> Iterator[tuple[str, int, int | None, str | None]]:
    wide, order, heads = _elf_heads(data)
    layout = order + ("IBBHQQ" if wide else "IIIBBH")
    for h in heads:
        if h[1] != _SHT_SYMTAB:
            continue
        if h[6] >= len(heads):
            raise FormatError("no symbol name table")
        strings, table = _cut(data, heads[h[6]][4], heads[h[6]][5]), _cut(data, h[4], h[5])
        for at in range(struct.calcsize(layout), len(table), struct.calcsize(layout)):
            own = _unpack(layout, table, at)
            name, value, size, section = (own[0], own[4], own[5], own[3]) if wide else (own[0], own[1], own[2], own[5])
            yield _string(strings, name), value, size, heads[section][-1] if 0 < section < len(heads) else None


def _elf_relocations(data: bytes) -> Iterator[tuple[str, int, int, int, int | None]]:
    wide, order, heads = _elf_heads(data)
    for h in heads:
        if h[1] not in (_SHT_RELA, _SHT_REL):
            continue
        if h[7] >= len(heads):
            raise FormatError("relocations of no section")
        plus = h[1] == _SHT_RELA
        layout = order + ("QQ" if wide else "II") + (("q" if wide else "i") if plus else "")
        table = _cut(data, h[4], h[5])
        for at in range(0, len(table), struct.calcsize(layout)):
            own = _unpack(layout, table, at)
            symbol, kind = divmod(own[1], 1 << (32 if wide else 8))
            yield heads[h[7]][-1], own[0], kind, symbol - 1, own[2] if plus else None


def _macho_commands(data: bytes) -> Iterator[tuple[int, int]]:
    """(command, place) of each load command."""
    order, bits = MACHO[data[:4]]
    at = 32 if bits == 64 else 28
    for _ in range(_unpack(order + "I", data, 16)[0]):
        command, size = _unpack(order + "II", data, at)
        if size < 8:
            raise FormatError("load command without size")
        yield command, at
        at += size


def _macho_heads(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, offset, length, offset of relocations, their number) of each section."""
    order = MACHO[data[:4]][0]
    for command, at in _macho_commands(data):
        if command not in (_LC_SEGMENT, _LC_SEGMENT_64):
            continue
        wide = command == _LC_SEGMENT_64
        for k in range(_unpack(order + "I", data, at + (64 if wide else 48))[0]):
            own = at + (72 + 80 * k if wide else 56 + 68 * k)
            name = _cut(data, own, 16).rstrip(b"\0").decode("utf-8", "replace")
            length, offset = _unpack(order + ("QI" if wide else "II"), data, own + (40 if wide else 36))
            yield name, offset, length, *_unpack(order + "II", data, own + (56 if wide else 48))


def _macho_sections(data: bytes) -> Iterator[tuple[str, bytes]]:
    for name, offset, length, _, _ in _macho_heads(data):
        yield name, _cut(data, offset, length)


def _macho_symbols(data: bytes) -> Iterator[tuple[str, int, int | None, str | None]]:
    order, bits = MACHO[data[:4]]
    layout = order + ("IBBHQ" if bits == 64 else "IBBHI")
    names = [h[0] for h in _macho_heads(data)]
    for command, at in _macho_commands(data):
        if command != _LC_SYMTAB:
            continue
        place, count, strings, size = _unpack(order + "4I", data, at + 8)
        table = _cut(data, strings, size)
        for k in range(count):
            name, kind, section, _, value = _unpack(layout, data, place + k * struct.calcsize(layout))
            defined = not kind & _N_STAB and kind & _N_TYPE == _N_SECT and 0 < section <= len(names)
            yield _string(table, name), value, None, names[section - 1] if defined else None


def _macho_relocations(data: bytes) -> Iterator[tuple[str, int, int, int, int | None]]:
    order = MACHO[data[:4]][0]
    for name, _, _, place, count in _macho_heads(data):
        for k in range(count):
            address, rest = _unpack(order + "II", data, place + 8 * k)
            if address >> 31:  # a scattered one names an address, not a symbol
                yield name, address & 0xFFFFFF, address >> 24 & 0xF, -1, None
            elif order == "<":
                yield name, address, rest >> 28, rest & 0xFFFFFF if rest >> 27 & 1 else -1, None
            else:
                yield name, address, rest & 0xF, rest >> 8 if rest >> 4 & 1 else -1, None


def _kind(data: bytes) -> str:
    kind = sniff(data)
    if kind not in ("elf", "macho"):
        raise FormatError("unsupported file format")
    return kind


def sections(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an object file's sections."""
    yield from _elf_sections(data) if _kind(data) == "elf" else _macho_sections(data)


def symbols(data: bytes) -> Iterator[tuple[str, int, int | None, str | None]]:
    """(name, value, size, section) of an object file's symbols, without the empty
    first one of ELF; Mach-O has no sizes, and what isn't defined no section."""
    yield from _elf_symbols(data) if _kind(data) == "elf" else _macho_symbols(data)


def relocations(data: bytes) -> Iterator[tuple[str, int, int, int, int | None]]:
    """(section, offset, type, number of the symbol, addend) of an object file's
    relocations; -1 is no symbol, and only ELF's longer form has an addend."""
    yield from _elf_relocations(data) if _kind(data) == "elf" else _macho_relocations(data)


def is_relocatable(data: bytes) -> bool:
    """Whether an object file is a relocatable one; FormatError if it is none."""
    kind = sniff(data)
    if kind == "elf":
        return _unpack(("<" if data[5:6] == b"\x01" else ">") + "H", data, 16)[0] == _ET_REL
    if kind == "macho":
        return _unpack(MACHO[data[:4]][0] + "I", data, 12)[0] == _MH_OBJECT
    raise FormatError("unsupported file format")


def embedded_text(data: bytes) -> str | None:
    """Text of the section that holds embedded paths; None without one."""
    wanted = ELF_SECTION if sniff(data) == "elf" else MACHO_SECTION
    for name, content in sections(data):
        if name == wanted:
            try:
                return content.decode("utf-8")
            except UnicodeDecodeError as bad:
                raise FormatError("embedded paths are not UTF-8") from bad
    return None


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's members, without its symbol and name tables."""
    if data[:8] != ARCHIVE:
        raise FormatError("not an archive")
    at, long_names = 8, b""
    while at < len(data):
        head = data[at : at + 60]
        if len(head) < 60 or head[58:60] != b"`\n":
            raise FormatError("broken member header")
        try:
            size = int(head[48:58])
        except ValueError as bad:
            raise FormatError("broken member size") from bad
        name, content = head[:16].rstrip(b" "), _cut(data, at + 60, size)
        at += 60 + size + size % 2
        if name.startswith(b"#1/"):
            n = int(name[3:])
            name, content = content[:n].rstrip(b"\0"), content[n:]
        elif name == b"//":
            long_names = content
            continue
        elif name[:1] == b"/" and name[1:].isdigit():
            name = long_names[int(name[1:]) :].split(b"\n")[0].rstrip(b"/")
        else:
            name = name[:-1] if name.endswith(b"/") and name not in (b"/", b"/SYM64/") else name
        if name not in (b"/", b"/SYM64/", b"__.SYMDEF", b"__.SYMDEF SORTED"):
            yield name.decode("utf-8", "replace"), content


def elf_object(text: str, name: str = ELF_SECTION) -> bytes:
    """A minimal 64-bit little-endian relocatable file with one section of text."""
    body, names = text.encode(), b"\0" + name.encode() + b"\0.shstrtab\0"
    at_names = 64 + len(body)
    shoff = -(-(at_names + len(names)) // 8) * 8
    head = ELF + b"\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", _ET_REL, 62, 1, 0, 0, shoff, 0, 64, 0, 0, 64, 3, 2)
    own = struct.pack("<IIQQQQIIQQ", 1, 1, 0, 0, 64, len(body), 0, 0, 1, 0)
    strings = struct.pack("<IIQQQQIIQQ", 2 + len(name.encode()), 3, 0, 0, at_names, len(names), 0, 0, 1, 0)
    return head + body + names + bytes(shoff - at_names - len(names)) + bytes(64) + own + strings


def with_section(data: bytes, text: str, name: str = ELF_SECTION) -> bytes:
    """An ELF file with one section more.  What is there keeps its place: the text,
    a longer name table and a new section table go to the end."""
    if sniff(data) != "elf":
        raise FormatError("a section can be added to ELF files only")
    wide, order = data[4:5] == b"\x02", "<" if data[5:6] == b"\x01" else ">"
    word, at = order + ("Q" if wide else "I"), 40 if wide else 32
    shoff, sizes = _unpack(word, data, at)[0], 58 if wide else 46
    entry, count, names = _unpack(order + "3H", data, sizes)
    layout = order + ("IIQQQQIIQQ" if wide else "10I")
    if not shoff or names >= count:
        raise FormatError("no section name table")
    if entry != struct.calcsize(layout) or count > 0xFEFF:
        raise FormatError("section table can't take one more")
    heads = [list(_unpack(layout, data, shoff + k * entry)) for k in range(count)]
    table, body = _cut(data, heads[names][4], heads[names][5]), text.encode()
    longer = table + name.encode() + b"\0"
    heads[names][4:6] = len(data) + len(body), len(longer)
    heads.append([len(table), 1, 0, 0, len(data), len(body), 0, 0, 1, 0])
    out = data + body + longer
    out += bytes(-len(out) % 8)
    new = bytearray(out + b"".join(struct.pack(layout, *h) for h in heads))
    struct.pack_into(word, new, at, len(out))
    struct.pack_into(order + "H", new, sizes + 2, count + 1)
    return bytes(new)


def macho_object(text: str, name: str = MACHO_SECTION, segment: str = "__DATA") -> bytes:
    """A minimal 64-bit little-endian relocatable file with one section of text."""
    body = text.encode()
    at = 32 + 72 + 80
    head = b"\xcf\xfa\xed\xfe" + struct.pack("<iiIIIII", 0x01000007, 3, _MH_OBJECT, 1, 152, 0, 0)
    seg = struct.pack("<II16sQQQQiiII", _LC_SEGMENT_64, 152, segment.encode(), 0, len(body), at, len(body), 7, 7, 1, 0)
    sec = struct.pack("<16s16sQQIIIIIIII", name.encode(), segment.encode(), 0, len(body), at, 0, 0, 0, 0, 0, 0, 0)
    return head + seg + sec + body


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A GNU archive of (name, content)."""
    table, names = b"", []
    for name, _ in files:
        raw = name.encode()
        if len(raw) > 15:
            names.append(b"/%d" % len(table))
            table += raw + b"/\n"
        else:
            names.append(raw + b"/")
    out = [ARCHIVE]
    for raw, content in [*([(b"//", table)] if table else []), *zip(names, (c for _, c in files), strict=True)]:
        out += [raw.ljust(16), MEMBER, b"%-10d`\n" % len(content), content, b"\n" if len(content) % 2 else b""]
    return b"".join(out)
