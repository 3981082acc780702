"""Template residue, filler, error pages and scripts-required notices in texts.

One pass over every text, code set aside. Literals that every match of a
grammar must hold are derived from the grammars themselves; an Aho-Corasick
automaton of them finds the sentences worth a look, so nothing that a grammar
would match is left out. A match is discounted by its surroundings: quotation
marks, words of explanation or report in the sentence, the heading above or
the sentence that introduces it, and by density, the share of the sentence
that the matches fill. A notice fills its line and a form is thick with
fields, while prose about either is mostly other words.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .cn import simplified

REASONS = ("placeholder", "filler", "error_page", "scripts_required")

# The Latin words filler is made of.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
_LATIN = {w[:k] for w in LATIN for k in range(min(4, len(w)), len(w) + 1)} | {w for w in LATIN}
_COMMON = {"do", "in", "id", "non", "ad", "et", "ex", "labor", "dolor", "anim", "minim", "qui", "elit", "est", "sit", "sed", "ut", "eu", "ea", "tempo", "temp"}

NAME = r"[A-Za-z一-鿿][\w一-鿿.\- ]{0,30}"
# Delimiters that hold nothing but fields; what stands between them may be any name.
STRONG = re.compile(
    rf"\{{\{{\s*{NAME}(?:\|[^{{}}\n]{{0,30}})?\s*\}}\}}|\$\{{\s*{NAME}\s*\}}|<%[=-]?\s*{NAME}\s*%>|\{{%\s*{NAME}\s*%\}}|%\({NAME}\)[sd]|«\s*{NAME}\s*»|@@{NAME}@@|(?<![_A-Za-z0-9])__{NAME}?__(?![_A-Za-z0-9])"
    r"|[【（(《\[](?:请|此处|在此|待)(?:填写|填入|输入|补充|插入)[^】）)》\]\n]{0,30}[】）)》\]]|\[(?:insert|your|enter|fill in)\b[^\]\n]{0,30}\]", re.I)
# Nouns that name a form's fields; with weak delimiters only such names or identifiers count.
FIELD = r"(?:[一-鿿]{0,8}(?:名称|姓名|编号|日期|时间|负责人|联系人|经办人|批次号|单号|金额|数量|地址|电话|标题|部门|公司|客户|供应商|仓库|合同号|版本号)|[a-z]+(?:_[a-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]*)+|[A-Z]+(?:_[A-Z0-9]+)+|owner|warehouse|name|title|date|amount|address|phone|email|supplier|customer|company|author|quantity|price|department)"
WEAK = re.compile(rf"(?<!_)__{FIELD}__(?!_)|(?<![\w{{$%\])])\{{\s*{FIELD}\s*\}}|(?<=[\w%）)])\{{\s*{FIELD}\s*\}}|(?<!\[)\[\s*{FIELD}\s*\](?![\](])|<\s*{FIELD}\s*>|(?<![#\w&])#{FIELD}#|(?<=[一-鿿\w])#{FIELD}#|##?#?(?=#{FIELD}#)")
TAGS = re.compile(r"</?(?:title|address|p|br|div|span|b|i|td|tr|table|noscript|html|body|head|ul|li|a|h\d)\s*/?>", re.I)

# Words with which a text explains fields and fillers, and words with which it reports notices.
EXPLAINS = re.compile(
    r"模[板版]中|参数|取值|占位写法|占位符|写法|语法|变量|字段由|替换为|会替换|时替换|替换过程|未替换|渲染|转义|教程|例句|标记为|spelling|syntax|\bexplain(?:s|ed)\b|\bmarked\b|merge fields?|is filled (?:in )?by|placeholders?\b|templates?\b|replaced (?:by|with)|substitut|for example|such as|escap(?:e|ing)|tutorial|mock-?ups?", re.I)
REPORTS = re.compile(r"统计|出现\d+次|出现[了过]|记为|归因|差别|区别|解释|报障|例句|翻译|记录了|写入了|\b(?:counted|logged|noted|recorded|reported|attributed)\b|put down to|\bexplain(?:s|ed)\b", re.I)
FACTS = re.compile(r"\b[A-Z]{2}-\d{5}\b|\d{4}年\d{1,2}月\d{1,2}日|\d{4}-\d{2}-\d{2}")
QUOTED = re.compile(r"“[^”\n]*”|「[^」\n]*」|『[^』\n]*』|‘[^’\n]*’|\"[^\"\n]*\"|《(?!(?:请|此处|在此|待)(?:填写|填入|输入|补充|插入))[^》\n]*》")
FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~).*?(?:\n[ \t]*\1[^\n]*|$)", re.S)
INLINE = re.compile(r"`[^`\n]+`")

FILLER = re.compile(
    r"示例标题|段落文本将在此显示|此处应有[^。\n]{0,12}文字|这里是示例文字|[（(]内容待(?:编写|补充|完善)[）)]|占位段落|占位文字|样例内容|填充文字|(?:待定){3,}|(?:测试){2,}|(?:文字){3,}|(?:正文){3,}|测试内容一二三|"
    r"sample text goes here|insert (?:body )?(?:copy|text) here|(?:placeholder|dummy) text|text goes here|\basdf(?:ghjk?l?)?\b.*\b(?:asdf|qwer)|qwer ?zxcv|\bx{5,}(?:\s+x{3,})+|^\s*x{6,}\s*$|此处(?:为|是)占位", re.I | re.M)

OBJ = r"(?:the |this |your |an? )?(?:requested |required )?(?:page|file|document|report|resource|attachment|article|item|record|entry|link|content|view|table)"
ERROR = re.compile(
    rf"^\W*(?:sorry|oops|notice|error|warning|很遗憾|抱歉|对不起|提示|出错了)\s*[,!，！:：]*\s*(?:{OBJ}\b|(?:该|所请求的|您(?:要)?(?:查看|访问|请求)的|此|当前)[一-鿿]{{0,8}}(?:不存在|失败|无权|迁移|下线|移除|删除|无法|不可用|打开|超时|失效|过期))"
    rf"|^\W*{OBJ} (?:has been moved|could not be (?:found|loaded|opened|displayed)|(?:is )?(?:temporarily |currently )?unavail\w*|timed out|failed to (?:load|open|convert)|was not found|does not exist|no longer exists|is not available)"
    r"|^\W*(?:该|所请求的|您(?:要)?(?:查看|访问|请求)的|此|当前)[一-鿿]{1,8}?(?:已|暂时|正在)?[一-鿿]{0,4}(?:不存在|加载失败|转换失败|打开失败|无权访问|正在迁移|已下线|被移除|已移除|被删除|无法打开|无法访问|不可用|超时|已失效|已过期)"
    r"|^\W*(?:[45]\d\d\s*[-:：]?\s*)?(?:服务器开小差了|系统维护中|页面不存在|文件转换失败|预览服务异常|内部错误|服务不可用|网关超时|访问被拒绝|禁止访问|请求超时|加载失败|转换失败|数据库连接失败)"
    r"|^\W*(?:http/\d\.\d )?[45]\d\d\s*[-:：]?\s*(?:not found|forbidden|internal server error|bad gateway|service unavailable|gateway time-?out|unauthorized|bad request|access denied|too many requests)"
    r"|^\W*page not found\b|^\W*(?:not found|forbidden|internal server error|bad gateway|service unavailable|gateway time-?out)\W*(?:[\(\[]?[45]\d\d[\)\]]?)?\W*$"
    r"|\b[A-Za-z]{2,}(?:Exception|Error|Failure|Fault): +\S|\b[a-z]+(?:\.[a-z]+)+\.[A-Z]?\w*(?:Exception|Error)\b|^\W*[A-Z]\w+\.[A-Z]\w+\.\w*(?:EXCEPTION|ERROR)\b|^\W*\{\s*\x22(?:code|error|status)\x22\s*:\s*\x22?[45]\d\d\b.*(?:error|message|msg)|\bsqlstate\[|^\W*traceback \(most recent call|^\W*error \d+\s*[:(\[]|^\W*(?:fatal|panic|uncaught|ora-\d+|errno)\b *[:\[(]|java\.\w+\.\w+|at [\w.]+\([\w]+\.java:\d+\)", re.I | re.M)
TAIL = re.compile(
    r"requested resource was not found on this server|please try again in a few|if the problem persists|quote reference|(?:trace ?id|request id|错误编号|请求标识|error code) *[:：]?[ ]*[\w\-]*\d[\w\-]*|upstream connect error|reset before headers|维护窗口预计|带来不便敬请谅解|秒后自动跳转"
    r"|返回首页后重试|请稍后再试|联系系统管理员|链接可能已失效|已被作者删除|无法读取附件|服务暂时无法处理|点击此处返回上一页|(?:^|[-|·>]\s*)nginx(?:/[\d.]+)?\W*$|could not connect to server|max retries exceeded|read timed out|no such bucket", re.I | re.M)

ON = r"(?:启用|打开|允许|开启|运行|开放|放行|激活)"
SCRIPT = re.compile(
    rf"(?:请|需要|务必|必须|须|需)[^。！？\n]{{0,12}}{ON}[^。！？\n]{{0,10}}(?:java ?script|(?<![a-z])js(?![a-z])|脚本|动态内容)|(?:不支持|禁用了?|关闭了?|未启用|没有启用|未开启|没有开启|拦截了?)[^。！？\n]{{0,10}}(?:java ?script|(?<![a-z])js(?![a-z])|脚本|动态内容)"
    r"|没有脚本就没有正文|^\W*(?:loading|正在加载)?[.…\s]*若长时间无响应|内容由脚本生成|(?:java ?script|(?<![a-z])js(?![a-z])|脚本)[^。\n]{0,8}(?:已|被)?(?:关闭|禁用|未启用|拦截|不可用)|<noscript>|^\W*noscript *[:：]"
    r"|(?:enable|turn on|activate|allow|switch on|permit)\s+(?:client-side |page |browser )?(?:java ?script|js|scripts?|scripting)\b|(?:requires?|relies on|needs|works only with|cannot (?:load|run|be shown|be displayed) without|depends on|does not work without|must have)\s+(?:client-side |page |browser )?(?:java ?script|js|scripts?|scripting)\b"
    r"|(?:java ?script|scripts?|scripting) (?:is|are|has been|was|to be) (?:disabled|required|turned off|switched off|switched on|blocked|needed|off|not enabled|enabled)|checking your browser before|noscript fallback|content is hidden until", re.I | re.M)
SENTENCE = re.compile(r"(?<=[。！？!?])|(?<=[.;])\s+(?=[A-Z“\"])|\n+|(?<=>)(?=<p>)")


#: Letters, digits and delimiters in other forms; the grammars know Chinese punctuation in both widths.
_WIDE = re.compile("[\u00a0\u2000-\u200a\u2070-\u208e\u2100-\u214f\u2460-\u24ff\u3000\ufb00-\ufb06\uff03-\uff05\uff0e\uff0f-\uff19\uff1c-\uff1e\uff20-\uff3d\uff3f-\uff5d\U0001d400-\U0001d7ff]")
_HEADING = re.compile(r"^\s{0,3}#{1,6} |^\*\*[^*\n]+\*\*\s*$")
_INTRODUCES = re.compile(r"[:：]\s*$")


def required(pattern: re.Pattern) -> set[str] | None:
    """Literals, lower case, of which every match of ``pattern`` holds one; None if it may do without any."""
    try:
        from re import _constants as c, _parser
    except ImportError:  # without the parser every sentence is looked at
        return None

    def seq(items) -> set[str] | None:
        found: list[set[str]] = []
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is c.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                found.append({run})
                run = ""
            if op is c.BRANCH:
                alts = [seq(x) for x in arg[1]]
                if all(alts):
                    found.append(set().union(*alts))
            elif op is c.SUBPATTERN and (x := seq(arg[3])):
                found.append(x)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0 and (x := seq(arg[2])):
                found.append({w * arg[0] for w in x} if len(x) == 1 else x)
            elif op is c.IN and all(o is c.LITERAL for o, _ in arg):
                found.append({chr(v).lower() for _, v in arg})
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    return seq(_parser.parse(pattern.pattern, pattern.flags))


GRAMMARS = {"placeholder": (STRONG, WEAK), "filler": (FILLER,), "error_page": (ERROR, TAIL), "scripts_required": (SCRIPT,)}


def triggers() -> dict[str, int] | None:
    """Literals with the bits of the reasons they may be part of; None if some grammar needs none."""
    out: dict[str, int] = {}
    for k, r in enumerate(REASONS):
        for g in GRAMMARS[r]:
            words = required(g)
            if words is None:
                return None
            for w in words:
                out[w] = out.get(w, 0) | 1 << k
    for w in _LATIN - _COMMON:
        out[w[:4]] = out.get(w[:4], 0) | 1 << REASONS.index("filler")
    return out


def _automaton():
    import ahocorasick

    words = triggers()
    if words is None:
        return None
    a = ahocorasick.Automaton()
    for w, bits in words.items():
        a.add_word(w, bits)
    a.make_automaton()
    return a


_A: list = []
_ALL = (1 << len(REASONS)) - 1


def _latin(s: str) -> bool:
    ws = re.findall(r"[a-z]{2,}", s.lower())
    own = [w for w in ws if w in _LATIN]
    return len(ws) >= 5 and len(own) >= 0.7 * len(ws) and len({w for w in own if w not in _COMMON}) >= 2


def density(s: str, *grammars: re.Pattern) -> float:
    """The share of the characters of ``s``, blanks aside, that matches of the grammars fill."""
    seen = bytearray(len(s))
    for g in grammars:
        for m in g.finditer(s):
            seen[m.start():m.end()] = b"\1" * (m.end() - m.start())
    total = sum(not c.isspace() for c in s)
    return sum(1 for c, x in zip(s, seen) if x and not c.isspace()) / total if total else 0.0


def residue(text: str | None) -> list[str]:
    """The reasons in ``REASONS`` for which ``text`` lacks content; empty for null, empty and sound texts."""
    if not text:
        return []
    if not _A:
        _A.append(_automaton())
    t = FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    if "`" in t:
        t = INLINE.sub(" ", t)
    if _WIDE.search(t):
        t = unicodedata.normalize("NFKC", t)
    t = simplified(t)
    if "  " in t:
        t = re.sub(r"[ \t]{2,}", " ", t)
    low = t.lower()
    ends = None
    look: dict[int, int] = {}
    if _A[0] is None or len(low) != len(t):
        ends = [m.start() or m.end() for m in SENTENCE.finditer(t)] + [len(t)]
        look = dict.fromkeys(range(len(ends)), _ALL)
    else:
        for e, k in _A[0].iter(low):
            if ends is None:
                ends = [m.start() or m.end() for m in SENTENCE.finditer(t)] + [len(t)]
            i = bisect_right(ends, e)
            look[i] = look.get(i, 0) | k
    if not look:
        return []
    found: set[str] = set()
    sentence = lambda i: t[ends[i - 1] if i else 0:ends[i] if i < len(ends) else len(t)]
    for i, k in look.items():
        _judge(sentence(i), k, found, lambda i=i: _surroundings(i, sentence))
    return [r for r in REASONS if r in found]


def _surroundings(i: int, sentence) -> str:
    """What introduces a sentence: the one before it if that ends in a colon, and the heading above."""
    out = sentence(i - 1) if i and _INTRODUCES.search(sentence(i - 1)) else ""
    while i:
        i -= 1
        if _HEADING.search(s := sentence(i).strip("\n")):
            return out + " " + s
    return out


def _judge(s: str, kinds: int, found: set[str], around) -> None:
    q = QUOTED.sub(" ", s)
    if kinds & 1 and "placeholder" not in found:
        plain = QUOTED.sub(" ", TAGS.sub(" ", s))
        if STRONG.search(plain) or WEAK.search(plain):
            # an explanation shows few fields among many words
            if density(plain, STRONG, WEAK) >= 0.6 or not (EXPLAINS.search(s) or EXPLAINS.search(around())):
                found.add("placeholder")
    if kinds & 2 and "filler" not in found:
        if _latin(q) or (FILLER.search(q) and not (density(q, FILLER) < 0.5 and FACTS.search(s) and (EXPLAINS.search(s) or REPORTS.search(s)))):
            found.add("filler")
    if kinds & 4 and "error_page" not in found:
        n = TAGS.sub(" ", s if s.lstrip(" <>p").startswith("{") else q)
        if (ERROR.search(n) or TAIL.search(n)) and not _reported(s, n, ERROR, TAIL):
            found.add("error_page")
    if kinds & 8 and "scripts_required" not in found and SCRIPT.search(q) and not _reported(s, q, SCRIPT):
        found.add("scripts_required")


def _reported(s: str, n: str, *grammars: re.Pattern) -> bool:
    """Whether a sentence tells of a notice instead of being one: it names an occasion, or reports, and is mostly other words."""
    if not (REPORTS.search(s) or FACTS.search(s)) or density(n, *grammars) >= 0.6:
        return False
    for g in grammars:
        n = g.sub(" ", n)
    return bool(REPORTS.search(s) or FACTS.search(n))


def template_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, reasons`` of the documents in which content is missing, to be excluded.

    Every text is read whole. Null and empty texts hold nothing that stands in
    for content and give no row; repeated rows are judged each.
    """

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(i, r) for i, t in zip(pdf["i"], pdf["t"]) if (r := residue(t))]
            yield pd.DataFrame(out, columns=["doc_id", "reasons"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(scan, "doc_id long, reasons array<string>")
