from __future__ import annotations

import random

from loomgraph.llm.leakage import Passage, Screen, leaked_passages, plain
from loomgraph.llm.packing import pack, pack_histogram, token_counts
from loomgraph.llm import residue as residues
from loomgraph.llm.residue import residue, template_residue

DOC = "doc_id long, text string, extra string"


def test_residue():
    bad = {
        "placeholder": ["甲方：{{ warehouse | default }}\n乙方：某公司", "合同%(supplier_name)s约定", "| 名称 | [批次号] |", "自{warehouse}纳入的67份记录", "占比<doc_title>，护理部", "由__doc_title__于@@金额@@编制", "预计（此处填写交付日期）前完成"],
        "filler": ["Lorem ipsum dolor sit amet consectetur. Fugiat tempor irure.", "示例标题示例标题", "xxxxxxxx xxxxx xxxx xxxxxxx", "Sample text goes here."],
        "error_page": ["Sorry, your report has been moved (404)", "500 内部错误\n\n无法读取附件内容", "SQLSTATE[08006]: could not connect to server", "提示：该附件无权访问", '{"code": 500, "msg": "internal error", "data": null}'],
        "scripts_required": ["Please enable JavaScript and reload the page.", "请打开 JS以继续浏览", "检测到浏览器禁用了脚本", "<noscript>若长时间无响应，请更换浏览器"],
    }
    for reason, ts in bad.items():
        for t in ts:
            assert reason in residue(t), (reason, t)
    good = [None, "", "普通的说明文字。", "模板中的 {{客户名称}} 字段由信息科维护，生成合同HG-31137时会替换为实际名称。", "规范HE-69116列出了可用的占位写法，包括 <%= 批次号 %> 与 __owner__，由药剂科替换。", "正文\n\n```html\n<noscript>enable scripts</noscript>\n```\n\n结束", "```\nHTTP/1.1 404 Not Found\n```",
            "“系统维护中”的提示在2025年12月13日出现5次，信息科归因于报关资料缺页。", "Readers must enable JavaScript for the graph canvas, as the training office noted on 2024-01-01.", "复核结果【合格】与【待观察】由设备科填写。", "Values marked [draft] or <pending> in reports were settled.", "患者服用卡米胺50周后，<br>心脏超声提示数值为71.2&#37;。"]
    for t in good:
        assert residue(t) == [], t


def test_residue_misses_nothing_its_grammars_match():
    for t in ("（待填写）", "(待补充)", "(在此输入)", "《待补充》", "（在此填写金额）", "数据库连接失败", "禁止访问", "访问被拒绝", "429 Too Many Requests", "400 Bad Request", "fatal: not a repository", "ORA-00001: unique constraint",
              "java.lang.NullPointerException", "ＪＡＶＡ.lang.NullPointerException", "[your name]", "«客户名称»", "Occae ex ea consec sint dolor aliq ex aute duis."):
        assert residue(t), t
    assert residue("见《待补充协议》。") == ["placeholder"] and residue("见《补充协议》。") == []
    for gs in residues.GRAMMARS.values():
        for g in gs:
            assert residues.required(g)


def test_residue_density_and_surroundings():
    assert residue("模板 {{客户名称}}{{合同编号}}{{签订日期}}") == ["placeholder"]  # full of fields: no explanation
    assert residue("模板中的 {{客户名称}} 字段由工艺组维护，生成合同时会替换为实际名称，其余内容不变。") == []
    assert residue("# 占位符语法\n\n在正文里用 {{客户名称}} 就能得到往来单位的全称，末尾会自动加上年份与序号。") == []
    assert residue("# 合同\n\n在正文里用 {{客户名称}} 就能得到往来单位的全称，末尾会自动加上年份与序号。") == ["placeholder"]
    assert residue("The desk counted 31 cases in which the page timed out and put them down to the late import of customs papers.") == []
    assert residues.density("ab {{客户}} cd", residues.STRONG) == 0.6


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "请启用脚本，然后重新载入", "x"), (1, "请启用脚本，然后重新载入", "x"), (2, None, None), (3, "", ""), (4, "好" * 200_000, "")], DOC)
    assert [r.doc_id for r in template_residue(df).collect()] == [1, 1]
    assert template_residue(df.where("false")).count() == 0


def test_packing_histogram():
    rng = random.Random(3)
    for _ in range(20):
        h: dict[int, int] = {}
        for _ in range(rng.randint(0, 300)):
            k = rng.randint(1, 64)
            h[k] = h.get(k, 0) + 1
        got: dict[int, int] = {}
        boxes = 0
        for ls, n in pack_histogram(h, 64):
            assert sum(ls) <= 64 and n > 0
            boxes += n
            for x in ls:
                got[x] = got.get(x, 0) + n
        assert got == h
        assert boxes <= max(1, 1.25 * -(-sum(k * n for k, n in h.items()) // 64)) or not h
    assert pack_histogram({}, 64) == [] and pack_histogram({10: 600}, 100) == [((10,) * 10, 60)]


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, "药剂科 word " * rng.randint(1, 500), "x") for i in range(150)] + [(900, "很长 " * 20_000, ""), (901, None, ""), (902, "", "")]
    docs = spark.createDataFrame(rows, DOC)
    n = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    got = pack(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    per: dict[int, list] = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    for d, ps in per.items():
        assert sum(p.n_tokens for p in ps) == n[d] and (len(ps) == 1 or n[d] > 2048)
        assert sorted(p.tok_start for p in ps) == [2048 * k for k in range(len(ps))]
    boxes: dict[int, list] = {}
    for r in got:
        if r.n_tokens:
            boxes.setdefault(r.container_id, []).append((r.offset, r.n_tokens))
    for b in boxes.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
    assert len(boxes) <= -(-sum(n.values()) // 2048) + 2
    assert pack(docs.where("false")).count() == 0


ITEM = "请说明采购部在2023年2月17日之后应如何处理编号IX-72300的记录，并给出密封性的判定次序。若改用菲沙平，成本组应在第56天安排肌电图，并记录皮肤瘙痒是否缓解。棠州建磐润滑在2025年5月2日确认税负率为89万元，次月因报关资料缺页冲回78.9%。"
EN = "Question AK-81954: by how much does retention band move from 67.5% if late customs papers recurs within 33 days? The reviewer notes that lot TL-80826 was released under concession gradually although label legibility had been accepted on 2024-04-18. Explain which record the maintenance section must close before 2023-10-25 when case RL-14524 and dose interval point to different causes."


def test_passages():
    p = Passage(ITEM)
    a, b, c = [s + "。" for s in ITEM.split("。")[:3]]
    fill = "若检测试剂盒的表面粗糙度连续出现偏差，采购部会把彩庭轴承列入观察清单。"
    assert p.match(plain(fill + ITEM + fill))[0] == 3
    assert p.match(plain(c + fill + a))[0] == 2
    assert p.match(plain(c.replace("。", "") + "<br>" + fill + a.replace("，", "\n")))[0] == 2
    assert p.match(plain(fill + b + fill))[0] == 1 and p.match(plain(fill + b))[1] < 60
    assert p.match(plain(ITEM[20:95]))[1] >= 60
    other = ITEM.replace("2023年2月17日", "2024年8月3日").replace("72300", "11846").replace("菲沙平", "奥维坦").replace("56", "19").replace("89万", "417万").replace("2025年5月2日", "2023年1月9日").replace("78.9", "3.3").replace("采购部", "护理部").replace("建磐", "文恩")
    assert p.match(plain(other))[0] < 2 and p.match(plain(other))[1] < 60
    edited = ITEM.replace("应如何", "应怎样").replace("并记录", "且记录").replace("確認", "确认")
    assert p.match(plain(edited))[0] == 3
    assert Passage(EN).match(plain(EN.upper()))[0] == 3


def test_leaks(spark):
    docs = [(1, "前文。" + ITEM + "后文。", ""), (1, "前文。" + ITEM + "后文。", ""), (2, "# 标题\n\n" + ITEM.split("。")[2] + "。\n\n别的内容。" + ITEM.split("。")[0] + "。", ""), (3, ITEM.split("。")[1] + "。", ""), (4, None, ""), (5, "", ""), (6, "Intro. " + EN, ""), (7, "无关" * 50_000, "")]
    d = spark.createDataFrame(docs, DOC)
    items = spark.createDataFrame([(10, ITEM), (11, EN), (12, None), (13, "")], "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in leaked_passages(d, items).collect())
    assert got == [(10, 1), (10, 2), (11, 6)]
    assert leaked_passages(d.where("false"), items).count() == 0 and leaked_passages(d, items.where("false")).count() == 0


def test_leaks_as_by_aligning_all(spark):
    rng = random.Random(5)
    whole = plain(ITEM)
    texts = [whole[k:k + 62] for k in range(0, len(whole) - 62, 3)]  # stretches from anywhere, marks gone
    texts += [ITEM[k:k + 64] for k in range(0, len(ITEM) - 64, 5)] + [EN[k:k + 145] for k in range(0, len(EN) - 145, 9)]
    for n in (3, 6, 9, 12, 20):  # edited again and again, so that no long run is left
        for t in (ITEM, EN):
            texts += ["".join("某" if i % n == k else c for i, c in enumerate(t)) for k in (0, 2)] + ["".join(c if rng.random() > 1 / n else "" for c in t)]
    items = [(10, ITEM), (11, EN)]
    # other documents make the terms at the edges of the sentences the rare ones
    docs = [(k, t, "") for k, t in enumerate(texts)] + [(1000 + k, ITEM[40:110] + str(k), "") for k in range(5)]
    want = set()
    for d, t, _ in docs:
        for i, x in items:
            p = Passage(x)
            hit, run = p.match(plain(t))
            if hit >= min(2, len(p.sents)) or run >= (140 if p.english else 60):
                want.add((i, d))
    got = {(r.item_id, r.doc_id) for r in leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 20 < len(want) < len(docs)
    other = ITEM.replace("72300", "11846").replace("2023年2月17日", "2024年8月3日").replace("56", "19").replace("89万", "417万").replace("2025年5月2日", "2021年1月9日").replace("78.9", "3.3")
    assert list(Screen([Passage(ITEM)], 60, 140).find([whole, "", plain(other)]))[:2] == [[0], []]
