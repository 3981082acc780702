from __future__ import annotations

import math
from datetime import datetime as D

from loomgraph.llm import cn, names
from loomgraph.llm.matching import company_records, fit_mixture, one_or_none
from loomgraph.llm.parse_names import Places, parse_org, parse_person, slip

P = Places({"崧崖", "崧州", "漪州", "漪崖", "棠浦", "棠州", "浔州", "浔崖", "霁溪", "澜溪"}, {"北崧", "云棠"})
O = "`订单号` string, `供应商` string, `供应商类别` string, extra string"
E = "id string, name_cn string, name_en string, name_abbr string, type string, description string, properties string, canonical_id string, deprecated_at timestamp_ntz"
S = "`发货单号` string, `客户名称` string, `客户类型` string, `收货地址` string"


def ent(i, cn_, ty="企业", en=None, ab=None, de=None, pr="{}", can=None):
    return (i, cn_, en, ab, ty, de, pr, can, None)


def test_pinyin_and_numerals():
    assert cn.syllables("宽平崧崖") == ["kuan", "ping", "song", "ya"]
    assert cn.numeral("三百二十七") == 327 and cn.numeral("十四") == 14 and cn.numeral("x") is None
    assert cn.folded("機１２") == "机12" and cn.near("sen", "seng") and not cn.near("san", "sen")
    assert cn.same_sound("重", "崇")


def test_parse_org():
    for t, want in {
        "北崧省崧崖迈端精密机械有限公司": ("崧崖", "迈端", "precision"), "迈端(崧崖)精机有公司": ("崧崖", "迈端", "precision"), "老迈端厂": (None, "迈端", None), "崧崖Maiduan精密機械 公司": ("崧崖", "maiduan", "precision"),
        "MAIDAUN PRECISION MACHINERY (SONGYA) CO LTD": ("崧崖", "maidaun", "precision"), "Songya Maiduan Preci. Limited": ("崧崖", "maiduan", "precision"), "迈端精机股份-采购部": (None, "迈端", "precision"), "【漪州宽平机电设备】（主供）": ("漪州", "宽平", "electromech"),
    }.items():
        r = parse_org(t, P)
        assert (r["city"], r["brand"], r["trade"]) == want, t
    assert parse_org(None, P)["brand"] == "" and parse_org("", P)["brand"] == ""


def test_parse_person():
    want = ("elizabeth", "wisabes")
    for t in ("Elizabeth Wisabes", "Wisabes, Liz", "ElizabethWisabes", "WISABES Elizabeth", "Liz·Wisabes", "Elizabeth Wisabes 博士"):
        assert parse_person(t) == want, t
    assert parse_person("单") == ("", "") and slip("wisabes", "wissabes") and slip("ab", "ba") and not slip("abcd", "abxy")


def test_collision_curve():
    b, r = names.tune(0.4, 0.95)
    assert b * r <= 512 and 1 - (1 - 0.4**r) ** b >= 0.95
    assert r == max(k for k in range(1, 17) if math.ceil(math.log(0.05) / math.log(1 - 0.4**k)) * k <= 512)


def test_minhash_recall(spark):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice(["kuan", "ping", "mai", "duan", "heng", "teng", "si", "zhu", "lin", "man"]) for _ in range(3)) for _ in range(120)]
    words += [w[:3] + w[4] + w[3] + w[5:] for w in words[:40]]
    got = {(r.a, r.b) for r in names.minhash_pairs(spark.createDataFrame([(w,) for w in words], "s string")).collect()}
    j = lambda a, b: len(names.qgrams(a) & names.qgrams(b)) / len(names.qgrams(a) | names.qgrams(b))
    ws = sorted(set(words))
    want = {(a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if j(a, b) >= 0.4}
    want = {p for p in want if abs(len(p[0]) - len(p[1])) <= 3}
    assert len(want & got) >= 0.95 * len(want)


def test_candidate_recall_on_all_sounds(spark):
    """Every two sounds of sf0.01 that the verification would accept, by brute force, against those looked up."""
    from loomgraph.session import load

    orders, ents = load(spark, "/root/testdata/sf0.01", "purchase_orders"), load(spark, "/root/testdata/sf0.01", "entities")
    places = names.learn_places(orders.selectExpr("`供应商` as t").unionByName(ents.where("canonical_id is null").selectExpr("name_cn as t")))
    nodes = names.make_nodes(names.records_of_names(names.written(orders, "purchase_orders", "供应商", "供应商类别"), places).unionByName(names.records_of_entities(ents, places)))[1].cache()
    got = {(r.a, r.b) for r in names.sound_pairs(nodes).collect()}
    for kind, alike in (("org", lambda x, y: names.brand_similarity(*x, *y)), ("person", lambda x, y: names.word_similarity(x[2], y[2]))):
        rows = sorted({(r.brand, r.latin, r.letters) for r in nodes.where(f"kind = '{kind}' and letters != ''").collect()}, key=lambda r: r[2])
        rows = [r if kind == "person" else r for r in rows]
        cut = (lambda r: r[:2]) if kind == "org" else (lambda r: r)
        want = {(x[2], y[2]) for i, x in enumerate(rows) for y in rows[i + 1:] if x[2] != y[2] and alike(cut(x), cut(y)) >= 0.9}
        assert len(want) > 8 and len(want & got) >= 0.95 * len(want), (kind, want - got)


def test_similarity_is_graded():
    sim = lambda a, b: names.brand_similarity(a, False, b, False)
    assert sim("宽平", "款平") > 0.9 and sim("华电", "电华") >= 0.9
    for a, b in (("华东", "华东电"), ("瑞丰", "端丰"), ("恒泰", "恒秦"), ("唐盛振", "潭正森")):
        assert 0 < sim(a, b) < 0.9, (a, b)  # the threshold rejects them, no gate before it
    assert names.brand_similarity("maiduan", True, "maidaun", True) == 0.95 and 0 < names.brand_similarity("maiduan", True, "maitun", True) < 0.9
    assert names.edits("abcd", "abdc") == 1 and names.edits("", "ab") == 2 and names.edits("kitten", "sitting") == 3
    assert names.sounded("重乐" * 6, "chongyue" * 6) == 0.99 and names.sounded("重乐", "chongle") == 1.0  # 4096 readings, and four
    assert names.monge_elkan("", "甲") == 0.0 and names.word_similarity("abc", "abd") < 0.9


def test_words_are_learnt(spark):
    brands = ["恒达", "瑞丰", "金海", "兴隆", "永盛", "宏远", "华美", "正大", "天成", "康泰"]
    rows = [f"{c}{b}{t}有限公司" for c in ("宁波市", "石家庄市") for b in brands for t in ("食品", "家具")] + [f"昆山{b}食品有限公司" for b in brands[:3]]
    p = names.learn_places(spark.createDataFrame([(r,) for r in [*rows, None, "", "永辉超市有限公司"]], "t string"))
    assert {"宁波", "石家庄"} <= p.cities and not any(c.startswith("永辉") for c in p.cities)
    for t, want in {"宁波恒达食品有限公司": ("宁波", "恒达", "食品"), "石家庄市瑞丰家具有限公司": ("石家庄", "瑞丰", "家具"), "瑞丰家具厂": (None, "瑞丰", "家具")}.items():
        r = parse_org(t, p)
        assert (r["city"], r["brand"], r["trade"]) == want, t
    assert not names.learn_places(spark.createDataFrame([], "t string")).cities


def found(spark, orders, ents):
    return {(r.tab, r.key_a, r.key_b) for r in names.name_variants(spark.createDataFrame(orders, O), spark.createDataFrame(ents, E)).collect()}


def test_variants(spark):
    a = ["漪州宽平机电设备有限公司", "漪州款平机电设备公司", "宽平机电", "漪州市Kuanping机电有限公司", "宽平(漪州)机电设备有公司"]
    b = ["漪州宽平线缆有限公司", "霁溪来然线缆有限公司", "澜溪来然线缆集团有限公司"]
    orders = [(f"o{i}", n, "Mechanical Parts" if n in a else "Electronics", "x") for i, n in enumerate([*a * 2, *b * 2, None, "—", ""])]
    got = found(spark, orders, [])
    full = {(x, y) for x in a for y in a if x < y}
    assert {(x, y) for _, x, y in got} == full
    assert found(spark, [], []) == set()


def test_entities(spark):
    ents = [ent("1", "崧崖迈端精密机械有限公司"), ent("2", "迈端精机", pr='{"city": "崧崖市"}'), ent("2", "迈端精机", pr='{"city": "崧崖市"}'), ent("3", "崧州迈端精密机械有限公司"), ent("4", "迈端", de="主营精密机械，登记地崧崖"),
            ent("5", "Nicholas Kayavomm", "人员"), ent("6", "N. Kayavomm", "人员", en="Nicholas Kayavomm"), ent("7", "Kayavomm, Nick", "人员"), ent("8", "Robert Kayavomm", "人员"), ent("9", "崧崖迈端精密机械有限公司", can="c-1"), ent("10", None), ent("11", "X" * 3000)]
    got = {(x, y) for _, x, y in found(spark, [], ents)}
    assert got == {("1", "2"), ("1", "4"), ("2", "4"), ("5", "6"), ("5", "7"), ("6", "7")}


def test_companies(spark):
    o = spark.createDataFrame([("o1", "漪州款平机电设备公司", "Mechanical Parts", ""), ("o1", "漪州款平机电设备公司", "Mechanical Parts", ""), ("o2", "—", None, ""), ("o3", None, None, ""), ("o4", "霁溪市来然线缆有限公司", "Electronics", ""), ("o5", "宽平机电", None, "")], O)
    s = spark.createDataFrame([("s1", "宽平(漪州)机电有公司", "制造企业", "漪州市凤池县凌浩路146号"), ("s2", "来然线缆", None, "澜溪市新垣区品顺路28号")], S)
    e = spark.createDataFrame([ent("e1", "漪州宽平机电设备有限公司"), ent("e2", "Kuanping Electromechanical (Yizhou) Co., Ltd."), ent("e3", "漪州宽平线缆有限公司"), ent("e4", "澜溪市来然线缆集团有限公司"), ent("e5", "棠州科欧自动化有限公司")], E)
    # plain cases from which the mixtures learn what agreement looks like
    cities, brands = ["崧崖", "崧州", "漪崖", "棠浦"], ["迈端", "恒腾", "思筑", "林满", "朋业", "国盟", "云金", "卓恒", "科欧", "文彰", "利秀", "博涛", "超坤", "荣伦", "宏万", "飞睿"]
    more = [(f"m{j}", f"{cities[j % 4]}市{b}轴承有限公司", "装备制造", f"{cities[j % 4]}市北塘区德宝巷{j + 1}号") for j, b in enumerate(brands)]
    more += [(f"n{j}", f"{b}轴承", None, None) for j, b in enumerate(brands)]
    s = s.unionByName(spark.createDataFrame(more, S))
    e = e.unionByName(spark.createDataFrame([ent("x" + k, n) for k, n, _, a in more if a], E))
    rows = [r for r in company_records(o, s, e).collect() if r.src_key[0] not in "mn"]
    assert {(r.src_key, r.entity_id) for r in rows} == {("o1", "e1"), ("o1", "e2"), ("o5", "e1"), ("o5", "e2"), ("s1", "e1"), ("s1", "e2"), ("s2", "e4")}
    assert all(0.5 < r.confidence <= 1 for r in rows)
    assert company_records(o.where("false"), s.where("false"), e).count() == 0


def test_mixture_separates():
    import numpy as np

    x = np.array([[1.0, 1.0], [0.95, 1.0], [0.1, 0.0], [0.2, 0.0]])
    odds = fit_mixture(x, np.array([5.0, 5, 50, 50]), np.array([4.5, 4.5, 2, 2]), 0.02)
    assert (odds[:2] > 0).all() and (odds[2:] < 0).all()
    assert D


def test_one_company_or_none_by_enumeration():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(20):
        k = int(rng.integers(1, 6))
        odds, none = rng.normal(0, 3, k), float(rng.uniform(0.01, 0.5))
        # each hypothesis: no company, or company i and no other; companies are alike beforehand
        weight = [none] + [(1 - none) / k * math.exp(o) for o in odds]
        want = np.array(weight) / sum(weight)
        got, no = one_or_none(odds, np.zeros(k, dtype=int), np.ones(k, dtype=int), none)
        assert np.allclose(got, want[1:]) and np.allclose(no, want[0])
    got, no = one_or_none(np.array([2.0, -1.0]), np.array([0, 0]), np.array([2, 1]), 0.1)  # two companies that look the same
    assert abs(2 * got[0] + got[1] + no[0] - 1) < 1e-12 and got[0] < 0.5


def test_the_mixture_decides(spark, monkeypatch):
    """With likelihood ratios that say nothing, nothing is matched: no rule beside the mixture does it."""
    from loomgraph.llm import matching

    o = spark.createDataFrame([(f"o{i}", n, None, "") for i, n in enumerate(["漪州宽平机电设备有限公司", "漪州宽平机电", "霁溪来然线缆有限公司"])], O)
    e = spark.createDataFrame([ent("e1", "漪州宽平机电设备有限公司"), ent("e2", "霁溪来然线缆有限公司")], E)
    s = spark.createDataFrame([], S)
    monkeypatch.setattr(matching, "fit_mixture", lambda x, *a: -20.0 * __import__("numpy").ones(len(x)))
    assert company_records(o, s, e).count() == 0


def test_every_sound_is_looked_up(spark):
    brands = [("安平", False), ("安明", False), ("anming", True), ("宁德", False)]
    nodes = spark.createDataFrame([("org", b, names.letters(b), la) for b, la in brands], "kind string, brand string, letters string, latin boolean")
    assert ("anming", "anping") in {(r.a, r.b) for r in names.sound_pairs(nodes).collect()}  # though another brand sounds like the slip
    a, b = (names.sound_keys(x, False, names.letters(x)) for x in ("平安", "品安"))
    assert a & b and a & names.sound_keys("pingan", True, "pingan") and names.sound_keys("品干", False, "pingan") & names.sound_keys("pingan", True, "pingan")


def test_slips_of_companies_need_no_comparison_by_chance(spark):
    """Problem 6: every two brands the verification accepts meet under a key, those of two wrong letters don't, however many bands they'd share."""
    brands = [("羽先天", False), ("先宇天", False), ("先勤朝", False), ("先勤涛", False), ("xianqinchoa", True), ("xianqinhao", True), ("仁宽乐", False), ("renkuanyeu", True), ("森精国精密", False), ("庭精国精密", False), ("庭精国精", False), ("行筑窗双", False), ("行筑窗", False), ("筑筑鑫", False), ("筑鑫", False)]
    nodes = spark.createDataFrame([("org", b, names.letters(b), la) for b, la in brands], "kind string, brand string, letters string, latin boolean")
    got = {frozenset((r.a, r.b)) for r in names.sound_pairs(nodes, listed=True).collect()}
    for i, (a, la) in enumerate(brands):
        for b, lb in brands[i:]:
            if names.brand_similarity(a, la, b, lb) >= 0.9:
                assert frozenset((names.letters(a), names.letters(b))) in got, (a, b)
    assert frozenset(("renkuanle", "renkuanyeu")) in got  # a slip against a rarer reading
    assert frozenset(("xianqinchao", "xianqintao")) not in got and frozenset(("xianqinchao",)) in got
    assert frozenset(("xianqinchao", "xianqintao")) in {frozenset((r.a, r.b)) for r in names.sound_pairs(nodes).collect()}


def test_listed_keys_at_random():
    import random

    r = random.Random(5)
    pool, accepted = "宽款平瓶迈端恒腾筑林满朋国卓乐重盛长行朝单曾沈仁越若胜深生升鑫深张章庄双霜床窗壮状", 0
    keys = lambda b, la: names.sound_keys(b, la, names.letters(b)) | names.slip_keys(b, la, names.letters(b))
    for _ in range(3000):
        x = "".join(r.choice(pool) for _ in range(r.randint(2, 9)))
        y, latin = list(x), r.random() < 0.5
        if latin:
            y = [c for z in y for c in r.choice(sorted(cn.sounds(z)))]
        for _ in range(1 if latin else r.randint(1, 2)):
            i = r.randrange(max(1, len(y) - 1))
            y[i:i + 2] = r.choice((y[i + 1:i + 2], y[i:i + 2][::-1], [r.choice("aehngu" if latin else pool), *y[i:i + 2]], [r.choice("aehngu" if latin else pool), *y[i + 1:i + 2]]))
        y = "".join(y)
        if y and names.brand_similarity(x, False, y, latin) >= 0.9:
            accepted += 1
            assert keys(x, False) & keys(y, latin), (x, y)
    assert accepted > 300


def test_edits_by_the_whole_table():
    import random

    def whole(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(r.choice("abn") for _ in range(r.randint(0, 7))) for _ in range(2))
        assert names.edits(a, b) == whole(a, b), (a, b)
