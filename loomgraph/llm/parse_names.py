"""Organisation and person names taken apart: city, brand, trade, legal form; given name, surname."""

from __future__ import annotations

import json
import re

from .cn import folded, pinyin

# Trades with their Chinese writings (full, short) and their English name.
TRADES = {
    "metal": ("金属制品", "金属", "Metal Products"), "precision": ("精密机械", "精机", "Precision Machinery"), "automation": ("自动化工程", "自动化", "Automation Engineering"),
    "steel": ("特种钢材", "特钢", "Special Steel"), "lubricant": ("润滑油品", "润滑", "Lubricants"), "electronics": ("电子科技", "电子", "Electronics"), "cable": ("线缆", "线缆", "Cables"),
    "electromech": ("机电设备", "机电", "Electromechanical"), "medical": ("医疗器械", "医械", "Medical Devices"), "packaging": ("包装印刷", "包装", "Packaging and Printing"),
    "rubber": ("橡塑制品", "橡塑", "Rubber and Plastics"), "energy": ("新能源装备", "新能源", "New Energy Equipment"), "pharma": ("生物制药", "药业", "Biopharmaceuticals"),
    "logistics": ("物流服务", "物流", "Logistics"), "paper": ("纸业", "纸业", "Paper"), "semiconductor": ("半导体材料", "半导体", "Semiconductor Materials"), "bearing": ("轴承制造", "轴承", "Bearings"),
    "chemical": ("化工材料", "化工", "Chemical Materials"), "optics": ("光电仪器", "光电", "Optoelectronic Instruments"), "building": ("智能楼宇", "楼宇", "Smart Building"),
}
_WORDS = sorted(((w, k) for k, t in TRADES.items() for w in {t[0], t[1]}), key=lambda x: -len(x[0]))
_EN = {k: re.sub("[^a-z]", "", t[2].lower()) for k, t in TRADES.items()}
_FORM = re.compile(r"(?:集团有限公司|股份有限公司|有限责任公司|有限公司|集团公司|股份公司|有限责任|\(有\)公司|有公司|有限公|有限|公司|集团|股份|厂|那家|co\.?,? ?ltd\.?|limited|ltd\.?|inc\.?|corp\.?|llc)$", re.I)
_FORM_EN = re.compile(r"[\s,.]*\b(?:co\.?\s*,?\s*ltd|company limited|limited|ltd|inc|corp|llc)\b[\s.]*$", re.I)
_NOTE = re.compile(r"[-—–_/][一-鿿]{1,5}(?:部|区|处|组|科|店|库|中心|分部)$|\((?!有\))[^()]{1,8}\)$")
#: Provinces and cities are learnt from the texts themselves; only the wordings they stand in are given.
_AFTER = r"(?!场|政|区$|有限|股份|集团|公司)"
PLACE = re.compile(rf"(?:^|省)([一-鿿]{{2,4}}?)市{_AFTER}|\(([一-鿿]{{2}})市?\)(?=.)|\(([一-鿿]{{3,4}})市\)(?=.)|登记地([一-鿿]{{2,4}})$|^位于([一-鿿]{{2,4}}?)的")
PROVINCE = re.compile(r"^([一-鿿]{2,3}?)省")


class Places:
    """Cities and provinces, with the cities' pinyin, and the words for trades: those given and those learnt."""

    def __init__(self, cities: set[str], provinces: set[str], trades: set[str] = frozenset()):
        self.cities, self.provinces = set(cities), set(provinces)
        self.words = sorted([*_WORDS, *((w, w) for w in trades)], key=lambda x: (-len(x[0]), x[0]))
        self.lengths = sorted({len(c) for c in self.cities}, reverse=True)
        self.prov_lengths = sorted({len(c) for c in self.provinces}, reverse=True)
        self.latin = {}
        for c in sorted(self.cities):
            self.latin.setdefault("".join(map(pinyin, c)), []).append(c)
        self.latin_prov = {"".join(map(pinyin, p)): p for p in sorted(provinces)}

    def by_latin(self, s: str) -> list[str]:
        """Cities written ``s``; else those one slip away."""
        return self.latin.get(s) or [c for k, cs in self.latin.items() if abs(len(k) - len(s)) < 2 and slip(k, s) for c in cs]

    def city_at(self, t: str) -> str:
        """The longest city that ``t`` begins with, or nothing."""
        return next((t[:n] for n in self.lengths if t[:n] in self.cities), "")

    def province_at(self, t: str) -> str:
        return next((t[:n] for n in self.prov_lengths if t[:n] in self.provinces), "")

    def trade_at_end(self, t: str) -> tuple[str, str]:
        """The longest word for a trade that ``t`` ends in, something being left before it, and the trade's key."""
        return next(((w, k) for w, k in self.words if t.endswith(w) and len(t) > len(w)), ("", ""))


def places_of(text: str | None) -> tuple[list[str], list[str]]:
    """City and province writings in one name, address, description or property."""
    if not text:
        return [], []
    t = re.sub(r"\s+", "", folded(text))
    return [next(g for g in m if g) for m in PLACE.findall(t)], PROVINCE.findall(t)


def unknown_words(name: str | None, places: Places) -> list[tuple[str, str, str]]:
    """What a company's name may teach: ``brand`` for one between known words; else words at its ends with what is left of it.

    Only names in characters with a legal form count. A ``trade`` is an end
    before which many different heads stand, a ``city`` a beginning before
    several brands known from elsewhere.
    """
    t = re.sub(r"[\s【】\[\]《》“”\"]", "", folded(name)) if name else ""
    t = _NOTE.sub("", t)
    core, form = _formless(t)
    core = re.sub(r"\([^()]*\)|[()]", "", core)
    if not form or not re.fullmatch(r"[一-鿿]{2,16}", core):
        return []
    if (p := places.province_at(core)) and (core[len(p):len(p) + 1] == "省" or places.city_at(core[len(p):])):
        core = core[len(p):].removeprefix("省")
    city = places.city_at(core) if len(core) > 2 else ""
    if city:
        core = core[len(city):].removeprefix("市") or core
    word, _ = places.trade_at_end(core)
    out = [("name", "", "")]
    if word:
        core = core[:-len(word)]
        if city:
            out.append(("brand", core, ""))
        else:
            out += [("city", core[:n], core[n:]) for n in (2, 3) if len(core) - n >= 2]
    else:
        out += [("trade", core[-n:], core[:-n]) for n in (2, 3, 4, 5) if len(core) - n >= 2]
    return out


def _formless(t: str) -> tuple[str, str]:
    """A name without its legal form, and the form."""
    form = ""
    for _ in range(3):
        m = _FORM.search(t)
        if not m or m.start() == 0:
            break
        form = m[0].lower() + form
        t = t[:m.start()].rstrip("(").replace("(有)", "")
    return t, form


def slip(a: str, b: str) -> bool:
    """Whether two words are the same but for one letter too many, too few, wrong, or two swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i:len(a) - j], b[i:len(b) - j]
    return len(x) <= 1 and len(y) <= 1 or (len(x) == 2 and x == y[::-1])


def _trade_en(words: list[str]) -> tuple[str | None, int]:
    """The trade that the last words name, in full, with a slip or cut off with a point, and how many words that takes.

    A cut-off word that may stand for several trades takes its word and names none.
    """
    for n in (2, 3, 1):
        if len(words) < n:
            continue
        tail = "".join(words[-n:])
        bare = re.sub("[^a-z]", "", tail)
        if len(bare) < 3:
            continue
        cut = [k for k, w in _EN.items() if w.startswith(bare)] if n == 1 and (tail.endswith(".") or len(bare) >= 5) else []
        for k, w in _EN.items():
            if bare == w or (len(bare) > 5 and slip(bare, w)):
                return k, n
        if cut:
            return (cut[0] if len(cut) == 1 else None), n
    return None, 0


def _squeezed(t: str, out: dict, places: Places) -> dict:
    """The same without trusting blanks: parts are peeled off both ends of the bare letters."""
    s = re.sub(r"\s+", "", t.lower())
    s = re.sub(r"[,.]*(?:co\.?,?ltd|limited|ltd)\.?$", lambda m: "." if m[0].startswith(".") else "", s)
    m = re.search(r"\(([a-z]+)\)", s)
    if m:
        c = places.by_latin(m[1])
        out["city"] = c[0] if c else None
        s = s[:m.start()] + s[m.end():]
    else:
        k = max((k for k in places.latin if s.startswith(k) and len(s) > len(k) + 5), key=len, default=None)
        if k:
            out["city"], s = places.latin[k][0], s[len(k):]
    cut = s.endswith(".")
    s = re.sub("[^a-z]", "", s)
    for k, w in _EN.items():
        for n in (len(w), len(w) - 1, len(w) + 1):
            if len(s) > n + 2 and (s[-n:] == w or (len(w) > 5 and slip(s[-n:], w) and s[-n] == w[0])):
                out["trade"], out["brand"] = k, s[:-n]
                return out
    if cut:
        for n in (5, 6, 4, 3):
            ks = [k for k, w in _EN.items() if w.startswith(s[-n:])]
            if ks and len(s) > n + 2:
                out["trade"], out["brand"] = (ks[0] if len(ks) == 1 else None), s[:-n]
                return out
    out["brand"] = s
    return out


def parse_org(name: str | None, places: Places) -> dict:
    """``city, prov, brand`` (simplified characters, or lower-case letters), ``latin, trade, form`` of one writing."""
    out = {"city": None, "prov": None, "brand": "", "latin": False, "trade": None, "form": ""}
    if not name:
        return out
    t = folded(name).strip()
    t = re.sub(r"[【】\[\]《》“”\"]", "", t).replace("〔", "(").replace("〕", ")")
    if not re.search(r"[一-鿿]", _NOTE.sub("", t.replace(" ", ""))):
        return _parse_latin(_NOTE.sub("", t), out, places)
    t = re.sub(r"\s+", "", t)
    m = re.search(r"\(([一-鿿]{2,4}?)市?\)", t)
    if m and (m[1] in places.cities):
        out["city"] = m[1]
        t = t[:m.start()] + t[m.end():]
    for _ in range(2):
        t = _NOTE.sub("", t)
    t, out["form"] = _formless(t)
    t = t.replace("(有)", "")
    if t.startswith("老") and out["form"] == "厂" and len(t) > 2:
        t = t[1:]
    t = re.sub(r"[()]", "", t)
    p = places.province_at(t)
    if p and (t[len(p):len(p) + 1] == "省" or (places.city_at(t[len(p):]) and len(t) > len(p) + 2)):
        out["prov"], t = p, t[len(p):].removeprefix("省")
    c = places.city_at(t)
    if c and len(t) > len(c):
        rest = t[len(c) + 1:] if t[len(c)] == "市" and len(t) > len(c) + 1 else t[len(c):]
        if rest:
            out["city"], t = c, rest
    w, k = places.trade_at_end(t)
    if w:
        out["trade"], t = k, t[:-len(w)]
    out["brand"] = t
    if re.fullmatch(r"[A-Za-z'’ ]+", t):
        out["latin"], out["brand"] = True, re.sub("[^a-z]", "", t.lower())
    return out


def _parse_latin(t: str, out: dict, places: Places) -> dict:
    s0 = _FORM_EN.sub("", re.sub(r"\s+", " ", t.lower()).strip())
    out["latin"], out["form"] = True, "ltd"
    m = re.search(r"\(\s*([a-z ]+?)\s*\)", s0)
    words: list[str]
    if m:
        c = places.by_latin(m[1].replace(" ", ""))
        out["city"] = c[0] if len(c) >= 1 else None
        s0 = s0[:m.start()] + s0[m.end():]
        words = [w for w in s0.replace(",", " ").split() if w]
    else:
        words = [w for w in s0.replace(",", " ").split() if w]
        if len(words) > 2:
            c = places.by_latin(re.sub("[^a-z]", "", words[0]))
            if c:
                out["city"], words = c[0], words[1:]
    trade, n = _trade_en(words)
    if not n or len(words) <= n or any(len(w) == 1 for w in words) or re.search(r"\S\s{2,}\S|　", t):
        return _squeezed(t, out, places)
    out["trade"], words = trade, words[:-n]
    out["brand"] = re.sub("[^a-z]", "", "".join(words))
    return out


def letters(brand: str) -> str:
    """The sound of a brand in letters; unknown characters stay."""
    return "".join(pinyin(c) if "一" <= c <= "鿿" else c for c in brand.lower())


# Short forms of given names.
NICK = {
    "alex": "alexander", "al": "alexander", "sandy": "alexander", "ben": "benjamin", "benny": "benjamin", "dora": "dorothea", "dot": "dorothea", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth",
    "jen": "jennifer", "jenny": "jennifer", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "nicky": "nicholas", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "sam": "samuel", "sammy": "samuel", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "will": "william", "bill": "william", "billy": "william", "willy": "william", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "ed": "edward",
    "eddie": "edward", "ned": "edward", "fred": "frederick", "greg": "gregory", "harry": "henry", "hank": "henry", "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "larry": "lawrence", "matt": "matthew", "pat": "patricia",
    "patty": "patricia", "pete": "peter", "phil": "philip", "rick": "richard", "dick": "richard", "rich": "richard", "ron": "ronald", "steve": "stephen", "tim": "timothy", "tony": "anthony", "andy": "andrew", "drew": "andrew", "charlie": "charles", "chuck": "charles", "gabe": "gabriel",
    "abby": "abigail", "becky": "rebecca", "cathy": "catherine", "debbie": "deborah", "ellie": "eleanor", "nell": "eleanor", "gail": "abigail", "ginny": "virginia", "josie": "josephine", "judy": "judith", "kim": "kimberly", "mandy": "amanda", "nancy": "ann", "sally": "sarah", "terry": "theresa", "tina": "christina", "trish": "patricia",
}


def parse_person(name: str | None, known: set[str] | None = None) -> tuple[str, str]:
    """``given, surname`` in lower case; the given name may be one letter. Empty where the name is not of that form."""
    if not name:
        return "", ""
    t = folded(name).strip()
    t = re.sub(r"[一-鿿]+", " ", t)
    t = re.sub(r"\b(?:dr|mr|mrs|ms|prof|ph\.?d|engineer|jr|sr)\b\.?", " ", t, flags=re.I).strip(" -_/()（）")
    t = re.sub(r"[·•]", " ", t)
    if "," in t:
        a, _, b = t.partition(",")
        last, first = a, b
    else:
        w = t.split()
        if len(w) == 1:
            w = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t).split()
        if len(w) < 2:
            return "", ""
        first, last = (" ".join(w[1:]), w[0]) if w[0].isupper() and len(w[0]) > 2 and not w[-1].isupper() else (" ".join(w[:-1]), w[-1])
    first, last = re.sub("[^a-z]", "", first.lower()), re.sub("[^a-z]", "", last.lower())
    return NICK.get(first, first), last


_KEYS = ("city", "location", "城市", "所在地", "地区", "注册地")


def properties_of(props: str | None, description: str | None, places: Places) -> tuple[str | None, str | None, str]:
    """City, trade and class that a record's properties and description state."""
    city = trade = None
    klass = ""
    try:
        p = json.loads(props) if props else {}
    except ValueError:
        p = {}
    for v in p.values() if isinstance(p, dict) else []:
        if not isinstance(v, str):
            continue
        x = re.sub(r"市$", "", folded(v).strip())
        if x in places.cities:
            city = city or x
        else:
            k = next((k for w, k in places.words if x == w), None)
            trade = trade or k
            klass = klass if k else (klass or x)
    d = folded(description or "")
    m = re.search(r"位于([一-鿿]{2,4}?)的|登记地([一-鿿]{2,4})|^([一-鿿]{2,4}?)市[一-鿿]+类往来", d)
    if m:
        c = next(g for g in m.groups() if g)
        city = city or (c if c in places.cities else None)
    m = re.search(r"位于[一-鿿]{2,4}?的([一-鿿]+?)企业|主营([一-鿿]+?)，|市([一-鿿]+?)类往来", d)
    if m:
        w = next(g for g in m.groups() if g)
        trade = trade or next((k for x, k in places.words if x == w), None)
    m = re.match(r"([一-鿿]+)，[一-鿿]{2}省内客商", d)
    if m and not klass:
        klass = m[1]
    return city, trade, klass
