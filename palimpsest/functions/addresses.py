"""Chinese addresses: parts of a text from country to room, and their fusion around recognised pieces.

Works on UTF-8 bytes, since windows are counted in bytes and may begin or end within a character.

A part has a level, 1 (room) to 11 (country). A scan reads a window with a list of readers, coarsest first; the first that
reads something at a place moves on to its end. Fusion grows a chain of parts to the right while the next one is finer by
one level or an allowed leap, then to the left while it is coarser by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import NamedTuple

ROOM, FLOOR, BUILDING, PLACE, NUMBER, ROAD, TOWN, DISTRICT, CITY, PROVINCE, COUNTRY = range(1, 12)

# Words by level; the first of a list that fits counts. Fixed values.
COUNTRIES = "中国 中華人民共和國 中华人民共和国 中國大陸 中国大陆 臺灣 台湾 香港 澳門 澳门 英國 英国 美國 美国 日本".split()
PROVINCES = "省 自治区 自治州 盟 地区 特别行政区".split()
DISTRICTS = "区 區 县 縣 旗".split()
DISTRICT_NAMES = "新界 九龙 九龍".split()
TOWNS = "街道 镇 鎮 乡 鄉 开发区 经济技术开发区 科技园 科学园 工业园 工业区 产业园 科技園 科學園 工業園 工業區 產業園".split()
TOWN_NAMES = "铜锣湾 銅鑼灣 北角 荃湾 荃灣 将军澳 將軍澳 青衣 上环 上環".split()
PARKS = "科技园 科学园 工业园 工业区 产业园 科技園 科學園 工業園 工業區 產業園".split()
PLACES = "广场 中心 花园 花苑 苑 城 天地 大厦 大楼 港 塔 廊 坊 里 府 购物公园 购物艺术馆 廣場 花園 大廈 大樓 購物公園 購物藝術館".split()
ROADS = "大道 大街 环路 环线 道中 道东 道西 道南 道北 路 街 巷 弄 里 道 胡同 段 環路 環線".split()
BUILDINGS = "号楼 号館 號樓 館 栋 棟 幢 座".split()
FLOORS = "层 層 樓 楼".split()
ROOMS = "单元 室 房".split()
HEAVY = "。 ！ ？ ； ： 、 （ ） / \\ |".split()
LIGHT = b" \t\r\n,"

#: Bytes of a window, and characters that a chain may grow to the right.
WINDOW, GROWTH = 96, 48


def _one_of(words: Iterable[str], behind: str = "") -> re.Pattern[bytes]:
    return re.compile(behind.encode() + b"(?:" + b"|".join(re.escape(w.encode()) for w in words) + b")")


_COUNTRY, _PROVINCE, _DISTRICT, _TOWN, _ROAD = (_one_of(w) for w in (COUNTRIES, PROVINCES, DISTRICTS, TOWNS, ROADS))
_CITY = _one_of(["市"], "(?<!城)")
_HEAVY = _one_of(HEAVY)
_DISTRICT_NAME, _TOWN_NAME = _one_of(DISTRICT_NAMES), _one_of(TOWN_NAMES)
_BUILDING, _FLOOR, _ROOM = _one_of(BUILDINGS), _one_of(FLOORS), _one_of(ROOMS)
_NUMBER = re.compile("(?:号(?!楼)|號(?!樓))".encode())
_TAIL = re.compile("[ \t\r\n,]*(?:之|-)[ \t\r\n,]*[0-9]+".encode())
_DASHED_FLOOR = re.compile(b"F[0-9]+")
_OF = re.compile("之[ \t\r\n,]*[0-9]+".encode())
_PLACE_END = tuple(w.encode() for w in PLACES)
_PARK_END = tuple(w.encode() for w in PARKS)
_NO_CASTLE = re.compile("[ \t\r\n,]*(?:区|區|县|縣|市)".encode())
_LEAD = re.compile(rb"[^\x80-\xbf]")


class Part(NamedTuple):
    level: int
    start: int
    end: int


class Seed(NamedTuple):
    """A recognised piece: kind is "address", "organization" or anything else."""

    kind: str
    start: int
    end: int
    score: float = 0.0


class Address(NamedTuple):
    start: int
    end: int
    score: float


def _before(text: bytes, at: int) -> int:
    """Where the character before a place begins."""
    at -= 1
    while at > 0 and text[at] & 0xC0 == 0x80:
        at -= 1
    return max(at, 0)


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 or lead >= 0xF8 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _chars(text: bytes, a: int, b: int) -> int:
    return sum(1 for _ in _LEAD.finditer(text, min(a, b), max(a, b)))


def _light(text: bytes, a: int, b: int, most: int | None = None) -> bool:
    between = text[a:b]
    return not between.strip(LIGHT) and (most is None or len(between) <= most)


@dataclass(frozen=True)
class Named:
    """Reads a name of its level."""

    level: int
    names: re.Pattern[bytes]

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        m = self.names.match(text, at)
        return [Part(self.level, at, m.end())] if m else []


@dataclass(frozen=True)
class Suffixed:
    """Reads a suffix of its level; the part begins up to `reach` bytes before, behind separators and behind coarser marks."""

    level: int
    suffix: re.Pattern[bytes]
    coarser: re.Pattern[bytes]
    reach: int

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        m = self.suffix.match(text, at)
        if not m:
            return []
        start = at
        while start > low and at - start < self.reach:
            prior = _before(text, start)
            if text[prior] in LIGHT or _HEAVY.match(text, prior):
                break
            start = prior
        place = start
        while place < at:
            mark = self.coarser.match(text, place)
            place = mark.end() if mark else place + _width(text[place])
            start = mark.end() if mark else start
        return [Part(self.level, start, m.end())]


@dataclass(frozen=True)
class Counted:
    """Reads a unit with a digit (or letter) at most eight bytes before it."""

    level: int
    unit: re.Pattern[bytes]
    letters: bool
    across: bool  # light separators may stand between
    wide: bool = False  # digits and letters mix in one run

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        m = self.unit.match(text, at)
        if not m:
            return []
        for place in range(at - 1, max(low, at - 8) - 1, -1):
            byte = text[place : place + 1]
            if byte in (b" ", b"\t", b"\r", b"\n", b","):
                if not self.across:
                    break
                continue
            digit, letter = byte.isdigit(), self.letters and byte.isalpha()
            if digit or letter:
                run = (lambda b: b.isdigit() or b.isalpha()) if digit and self.wide else bytes.isdigit if digit else bytes.isalpha
                while place > low and run(text[place - 1 : place]):
                    place -= 1
                return [Part(self.level, place, m.end())]
        return []


class HouseNumber:
    """Reads a number's unit with digits before it, which may begin before the window, and a tail such as -2 behind it."""

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        m = _NUMBER.match(text, at)
        if not m:
            return []
        for place in range(at - 1, max(low, at - 8) - 1, -1):
            if text[place : place + 1].isdigit():
                while place > 0 and text[place - 1 : place].isdigit():
                    place -= 1
                tail = _TAIL.match(text, m.end(), high)
                return [Part(NUMBER, place, tail.end() if tail else m.end())]
        return []


class NamedPlace:
    """Reads up to sixteen characters that end as places do; a road within them is a part of its own."""

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        place = at
        for _ in range(16):
            if place >= high or _HEAVY.match(text, place):
                return []
            byte = text[place]
            if byte < 0x80 and not text[place : place + 1].isalpha():
                return []
            place += _width(byte)
            name = text[at:place]
            if name.endswith(_PLACE_END) and not self._walled(text, name, place):
                for start in range(at, place):
                    if road := _ROAD.match(text, start):
                        return [Part(ROAD, at, road.end()), Part(PLACE, road.end(), place)]
                return [Part(PLACE, at, place)]
        return []

    @staticmethod
    def _walled(text: bytes, name: bytes, end: int) -> bool:
        """A name of a district that goes on, not of a place."""
        return next(w for w in _PLACE_END if name.endswith(w)) == "城".encode() and bool(_NO_CASTLE.match(text, end))


@dataclass(frozen=True)
class Plain:
    level: int
    pattern: re.Pattern[bytes]

    def read(self, text: bytes, low: int, at: int, high: int) -> list[Part]:
        m = self.pattern.match(text, at, high)
        return [Part(self.level, at, m.end())] if m else []


READERS = (
    Named(COUNTRY, _COUNTRY),
    Suffixed(PROVINCE, _PROVINCE, _COUNTRY, 32),
    Suffixed(CITY, _CITY, _PROVINCE, 24),
    Named(DISTRICT, _DISTRICT_NAME),
    Suffixed(DISTRICT, _DISTRICT, _CITY, 24),
    Named(TOWN, _TOWN_NAME),
    Suffixed(TOWN, _TOWN, _DISTRICT, 24),
    Suffixed(ROAD, _ROAD, _TOWN, 32),
    HouseNumber(),
    NamedPlace(),
    Counted(BUILDING, _BUILDING, letters=True, across=True, wide=True),
    Counted(FLOOR, _FLOOR, letters=False, across=False),
    Plain(FLOOR, _DASHED_FLOOR),
    Plain(ROOM, _OF),
    Counted(ROOM, _ROOM, letters=True, across=False),
)


def scan(text: bytes, low: int, high: int) -> list[Part]:
    """All parts of a window."""
    out: list[Part] = []
    if not 0 <= low < high <= len(text):
        return out
    at = low
    while at < high:
        if text[at] not in LIGHT:
            found = next((parts for r in READERS if (parts := r.read(text, low, at, high))), [])
            if found:
                out += found
                at = found[-1].end
                continue
        at += 1
    return out


def window(text: bytes, low: int, high: int) -> tuple[frozenset[int], list[Part]]:
    """Levels and parts of a window, without parts finer than its last one, which are mostly misread.

    A level that went with one part is gone even if another part has it.
    """
    parts = scan(text, low, high)
    last = parts[-1].level if parts else 0
    return frozenset(p.level for p in parts if p.level >= last), [p for p in parts if p.level >= last]


def is_private(levels: Iterable[int]) -> bool:
    """Fine enough to find someone: a house number, or a place with a floor or a room."""
    levels = set(levels)
    return NUMBER in levels or (PLACE in levels and bool(levels & {FLOOR, ROOM}))


def has_private_detail(text: bytes, start: int, end: int) -> bool:
    return is_private(p.level for p in scan(text, start, end))


Chain = tuple[int, int]
#: Leaps to the right, (finest level so far, next level) -> whether a part fits behind the chain.
LEAPS: dict[tuple[int, int], Callable[[bytes, Chain, Part], bool]] = {
    (COUNTRY, TOWN): lambda t, c, p: _light(t, c[1], p.start, 4) and t[c[0] : c[1]].endswith("香港".encode()),
    (TOWN, BUILDING): lambda t, c, p: _light(t, c[1], p.start, 4) and t[c[0] : c[1]].endswith(_PARK_END),
    (NUMBER, TOWN): lambda t, c, p: t[p.start : p.end].endswith(_PARK_END) and (p.start <= c[1] < p.end or _chars(t, c[1], p.start) <= 4),
    (ROAD, PLACE): lambda t, c, p: _light(t, c[1], p.start, 4),
    (NUMBER, FLOOR): lambda t, c, p: _chars(t, c[1], p.start) <= 4,
    (PLACE, ROAD): lambda t, c, p: (m.end() if (m := _ROAD.match(t, c[1])) else c[1]) == p.end,
    (PLACE, FLOOR): lambda t, c, p: _chars(t, c[1], p.start) <= 4,
    (PLACE, ROOM): lambda t, c, p: _chars(t, c[1], p.start) <= 5,
    (BUILDING, ROOM): lambda t, c, p: _chars(t, c[1], p.start) <= 6,
    (DISTRICT, ROAD): lambda t, c, p: p.start <= c[1] < p.end,
    (CITY, ROAD): lambda t, c, p: p.start <= c[1] < p.end,
}


def joined_right(levels: frozenset[int], text: bytes, chain: Chain, part: Part) -> frozenset[int] | None:
    finest = min(levels, default=0)
    if finest in (0, part.level + 1):
        return levels | {part.level}
    fits = LEAPS.get((finest, part.level))
    if fits is None or not fits(text, chain, part):
        return None
    # A place that turns out to be the first half of a road's name is no place any more.
    return (levels - {PLACE} if (finest, part.level) == (PLACE, ROAD) else levels) | {part.level}


def joined_left(levels: frozenset[int], text: bytes, start: int, part: Part) -> frozenset[int] | None:
    coarsest = max(levels, default=0)
    if not coarsest:
        return None
    named = coarsest == ROAD and part.level == DISTRICT and text[part.start : part.end].endswith(tuple(w.encode() for w in DISTRICT_NAMES)) and _light(text, part.end, start, 4)
    return levels | {part.level} if part.level == coarsest + 1 or named else None


def grow(text: bytes, seed: Seed) -> Address | None:
    """The address around a seed, or none that is private."""
    levels, parts = window(text, seed.start, seed.end)
    start = seed.start
    scanned = scan(text, seed.start, seed.end)
    end = scanned[-1].end if scanned else seed.end

    while _chars(text, seed.end, end) < GROWTH:
        fine = any(level <= NUMBER for level in levels)
        if fine and _HEAVY.match(text, end):
            break
        step = None
        for part in window(text, end, min(end + WINDOW, len(text)))[1]:
            if part.level == DISTRICT and DISTRICT in levels:
                continue
            if fine and part.level >= DISTRICT:
                break  # another address
            if (more := joined_right(levels, text, (start, end), part)) is not None:
                step = more, min(start, part.start), part.end
                break
        if step is None:
            break
        levels, start, end = step

    while start > 0:
        step = None
        for part in reversed(window(text, max(0, start - WINDOW), start)[1]):
            if part.level == DISTRICT and DISTRICT in levels:
                continue
            if (more := joined_left(levels, text, start, part)) is not None:
                step = more, part.start
                break
        if step is None:
            break
        levels, start = step

    return Address(start, end, 0.9999 - 0.0025 * min(levels)) if is_private(levels) else None


def adjoined(text: bytes, seeds: list[Seed]) -> list[Seed]:
    """Address and organization seeds by start; addresses with only light separators between are one."""
    out: list[Seed] = []
    open_ = False  # whether the last of out may take up the next seed: no other kind came between
    for seed in sorted(seeds, key=lambda s: (s.start, -s.end)):
        if seed.kind not in ("address", "organization"):
            open_ = False
            continue
        last = out[-1] if out else None
        if open_ and last.kind == seed.kind == "address" and seed.start >= last.end and _light(text, last.end, seed.start):
            out[-1] = last._replace(end=seed.end, score=max(last.score, seed.score))
        else:
            out.append(seed)
        open_ = True
    return out


def fuse(text: bytes, seeds: list[Seed]) -> list[Address]:
    """Addresses around the seeds; a seed within an earlier one's address has none of its own."""
    out: list[Address] = []
    for seed in adjoined(text, seeds):
        if not any(a.start <= seed.start and seed.end <= a.end for a in out):
            if (address := grow(text, seed)) is not None:
                out.append(address)
    return out
