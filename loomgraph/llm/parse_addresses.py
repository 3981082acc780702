"""Chinese delivery addresses, in characters or romanised, taken apart into locality, street, number, site, building and room."""

from __future__ import annotations

import re

from .cn import folded, numeral, pinyin

CN = "零〇一二两三四五六七八九十百千"
NUM = rf"(?:\d+|[{CN}]+)"
# Kinds of streets with their English words, kinds of sites.
STREETS = {"路": ("road", "rd"), "街": ("street", "st"), "大道": ("avenue", "ave"), "巷": ("lane", "ln"), "胡同": ("hutong",), "道": ("dao",)}
SITES = ("双创基地", "智造谷", "保税仓", "科创园", "产业园", "物流港", "工业园", "创业园", "科技园", "仓储园", "园区")
_SITE_FIRST = re.compile(r"(?<![一-鿿])([一-鿿]{2,4}?)(" + "|".join(SITES) + r")(?=[一-鿿]{1,5}(?:大道|胡同|路|街|巷|道)[\d零〇一二两三四五六七八九十百千])")
_LEAD = re.compile(r"^(?:收货地址|收货|送货|送到|送至|送|地址|配送)\s*[:：]\s*")
_ZIP = re.compile(r"^\s*\d{6}(?!\d)\s*")
_NOTE = re.compile(r"门卫代收|北门进|南门进|东门进|西门进|工作日送货|前台收|前台代收|电话联系|到货前[一-鿿]*|提前[一-鿿]{0,4}|请[一-鿿]{1,6}|周末[一-鿿]*|仓库$|收发室|自提|代收")
STREET = re.compile(rf"([一-鿿]{{1,5}}?)(大道|胡同|路|街|巷|道(?={NUM}))(?:({NUM})(?:号(?!楼)|#(?!楼)|弄))?")
NUMBER = re.compile(rf"({NUM})(?:号(?!楼)|#(?!楼))")
BUILDING = re.compile(rf"第?({NUM})(?:号楼|#楼|栋|幢|座|楼栋|#)")
FLOOR = re.compile(rf"({NUM})(?:层|楼)")
ROOM = re.compile(r"(\d{3,5}|[A-Z]\d{2,4})(?:室|房|号房)?")


class Gazette:
    """Words for localities: provinces, cities and districts as learnt from the addresses, and slipped writings of them."""

    def __init__(self, provinces: set[str], cities: set[str], districts: set[str], slips: dict[str, dict[str, str]] | None = None):
        self.slips = slips or {}
        known = lambda k, xs: set(xs) | set(self.slips.get(k, ()))
        self.provinces, self.cities, self.districts = known("prov", provinces), known("city", cities), known("dist", districts)
        key = lambda s: "".join(map(pinyin, s))
        self.latin = {key(c): ("city", c) for c in sorted(cities)} | {key(p): ("prov", p) for p in sorted(provinces)}
        self.latin_district = {key(d): d for d in sorted(districts)}
        alt = lambda xs: "|".join(sorted(xs, key=lambda x: (-len(x), x))) or "(?!)"
        self.prov_re = re.compile(rf"({alt(self.provinces)})省?")
        self.city_re = re.compile(rf"({alt(self.cities)})市?")
        self.dist_re = re.compile(rf"({alt(self.districts)})(新区|区|县)?")

    def right(self, kind: str, word: str) -> str:
        """The locality that a writing stands for."""
        return self.slips.get(kind, {}).get(word, word)


LEARN = {
    "prov": re.compile(r"(?:^|[^一-鿿])([一-鿿]{2,3}?)省"), "city": re.compile(r"(?:^|省|[^一-鿿])([一-鿿]{2,4}?)市(?!场|政)"),
    "dist": re.compile(r"(?:市|[^一-鿿])([一-鿿]{2,3}?)(?<![园小社])(?:新区|区|县)"),
}


def slipped_words(counts: dict[str, int], rarer: int = 50) -> dict[str, str]:
    """Words that differ in one character from one ``rarer`` times as frequent, with that one; a rare word like no other is no slip."""
    masks: dict[tuple[str, int], tuple[int, str]] = {}
    for w, n in counts.items():
        for i in range(len(w)):
            k = (w[:i] + "?" + w[i + 1:], len(w))
            masks[k] = max(masks.get(k, (0, "")), (n, w))
    out = {}
    for w, n in counts.items():
        best = max(masks[(w[:i] + "?" + w[i + 1:], len(w))] for i in range(len(w)))
        alike = best[1] != w and any(pinyin(a)[:1] == pinyin(b)[:1] for a, b in zip(w, best[1]) if a != b)
        if alike and best[0] >= rarer * n:
            out[w] = best[1]
    return out


def locality_words(address: str | None) -> list[tuple[str, str]]:
    if not address:
        return []
    t = _ZIP.sub("", _LEAD.sub("", folded(address).strip()))
    return [(k, x) for k, p in LEARN.items() for x in p.findall(t)]


def sound(street: str) -> str:
    """The sound of a street's name, without the differences people don't hear when they type."""
    s = "".join(pinyin(c) if "一" <= c <= "鿿" else c for c in street.lower())
    return re.sub(r"n(?:g(?![aeiou])|(?=g$))", "n", re.sub(r"([zcs])h", r"\1", s)) if s else s


def _int(s: str) -> int | None:
    return int(s) if s.isdigit() else numeral(s)


EMPTY = {"prov": "", "city": "", "district": "", "street": "", "kind": "", "number": None, "site": "", "building": None, "room": ""}


def parse_address(address: str | None, g: Gazette) -> dict:
    """Parts of one writing; what it leaves out is empty or None."""
    out = dict(EMPTY)
    if not address:
        return out
    t = folded(address).strip()
    t = _ZIP.sub("", _LEAD.sub("", _ZIP.sub("", t)))
    if not re.search(r"[一-鿿]", _NOTE.sub("", t)):
        return _latin(t, out, g)
    t = _NOTE.sub("", t)
    for _ in range(2):
        t = re.sub(r"\s+", "", t)
    dash = re.sub(r"[,，、;；/()（）。:：]", "|", t)
    s = dash.replace("|", "").replace("－", "-")
    m = g.prov_re.search(s)
    if m and (m[0].endswith("省") or m.start() == 0 or s[m.end():m.end() + 2] in g.cities or m.end() == len(s)):
        out["prov"], s = g.right("prov", m[1]), s[:m.start()] + "|" + s[m.end():]
    m = next((m for m in g.city_re.finditer(s) if m[0].endswith("市")), None) or g.city_re.search(s)
    if m:
        out["city"], s = g.right("city", m[1]), s[:m.start()] + "|" + s[m.end():]
    m = next((m for m in g.dist_re.finditer(s) if m[2]), None) or next((m for m in g.dist_re.finditer(s) if m.start() == 0 or s[m.start() - 1] in "|-" or m.end() == len(s) or s[m.end()] in "|-"), None)
    if m:
        out["district"], s = g.right("dist", m[1]), s[:m.start()] + "|" + s[m.end():]
    m = _SITE_FIRST.search(s)
    if m:
        out["site"], s = m[1] + m[2], s[:m.start()] + "|" + s[m.end():]
    best = None
    for m in STREET.finditer(s):
        if m[3] and (best is None or not best[3]):
            best = m
        elif best is None:
            best = m
    rest = s
    if best:
        out["street"], out["kind"] = best[1], best[2]
        out["number"] = _int(best[3]) if best[3] else None
        rest = s[:best.start()] + "|" + s[best.end():]
    m = None if out["site"] else re.search(r"([一-鿿]{2,5}?)(" + "|".join(SITES) + ")", rest)
    if m:
        out["site"] = m[1] + m[2]
        rest = rest[:m.start()] + "|" + rest[m.end():]
    if out["number"] is None and (m := NUMBER.search(rest)):
        out["number"] = _int(m[1])
        rest = rest[:m.start()] + "|" + rest[m.end():]
    m = BUILDING.search(rest)
    if m:
        out["building"] = _int(m[1])
        rest = rest[:m.start()] + "|" + rest[m.end():]
    rest = FLOOR.sub("|", rest, count=1)
    m = ROOM.search(rest)
    if m:
        out["room"] = m[1].lstrip("0") or "0"
    return out


def _latin(t: str, out: dict, g: Gazette) -> dict:
    s = t.lower()
    s = re.sub(r"\b(rd|st|ave|ln|bldg|rm)\.", r"\1", s)
    m = re.search(r"no\.?\s*(\d+)\s+([a-z' ]+?)\s+(road|rd|street|st|avenue|ave|lane|ln|hutong|dao)\b", s)
    if m:
        out["number"] = int(m[1])
        out["street"] = re.sub("[^a-z]", "", m[2])
        out["kind"] = next(k for k, w in STREETS.items() if m[3] in w)
        s = s[:m.start()] + "," + s[m.end():]
    m = re.search(r"(?:building|bldg|block|tower)\s*(\d+)", s)
    if m:
        out["building"] = int(m[1])
        s = s[:m.start()] + "," + s[m.end():]
    m = re.search(r"(?:room|rm|unit|suite)\s*([a-z]?\d+)", s)
    if m:
        out["room"] = m[1].upper()
        s = s[:m.start()] + "," + s[m.end():]
    m = re.search(r"([a-z]+)\s+(?:new )?(?:district|county)", s)
    if m:
        out["district"] = g.latin_district.get(m[1], "")
        s = s[:m.start()] + "," + s[m.end():]
    for w in re.split(r"[,\s]+", s):
        k = g.latin.get(re.sub("[^a-z]", "", w))
        if k and not out[k[0]]:
            out[k[0]] = k[1]
    return out
