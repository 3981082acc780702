"""Chinese text helpers: script and width folding, numerals and pinyin."""

from __future__ import annotations

import re
import unicodedata

# Traditional characters and their simplified forms.
TRADITIONAL = (
    "璟號區責電備機業樓團潤東醫檢軸單應療設質數聯優縣樂順國匯達飛啟華興寶實層產龍廣員頁錯誤腳動態內無維護遷異請點擊統資訊網絡傳輸務財億萬與專門開關進出運營"
    "藥紙貿費發貨倉儲車間廠報關線纜鋼鐵鋁銅鋅錫鎳錄錦鑫鏈銷鋒銘銀錢韓陳劉張楊趙黃吳孫馬鄭謝許鄧馮蔡餘蘇盧蔣賈魏葉閻潘"
    "價條從來個們這裡說話讀寫學習書圖畫顯視聽見現觀點類題顏風驗體術環氣溫濕壓強膚臟腦劑複雜難離歡兒經給紅級約結終絡續組織細紀純納"
    "稱種積穩競筆節範築簡糧紛索綠編緩縮總績繼纖罰羅義習聖聲職腫膽臨舉舊艦藝節蓋薦處虛蟲術補裝製見規覺觸計訂訓記許訪評詞試詢該詳語認誌調論諮證識議讓"
    "負財貢貧購貴買賀賓賞賠賣賴賽贊贈趨躍踐輔輕載輯較轉辦邊還過適選遺鄰醬釋針鈣鈦錶鍵鍍鎖鏡長閃閉問閒閱隊陰陽階際險隨雙雞雲霧靜韻項須預領頭頻顆願顧飯飲館駐驅騰驚髮鬥魚鮮鳥麗麥黨齊齒龜榮")
SIMPLIFIED = (
    "璟号区责电备机业楼团润东医检轴单应疗设质数联优县乐顺国汇达飞启华兴宝实层产龙广员页错误脚动态内无维护迁异请点击统资讯网络传输务财亿万与专门开关进出运营"
    "药纸贸费发货仓储车间厂报关线缆钢铁铝铜锌锡镍录锦鑫链销锋铭银钱韩陈刘张杨赵黄吴孙马郑谢许邓冯蔡余苏卢蒋贾魏叶阎潘"
    "价条从来个们这里说话读写学习书图画显视听见现观点类题颜风验体术环气温湿压强肤脏脑剂复杂难离欢儿经给红级约结终络续组织细纪纯纳"
    "称种积稳竞笔节范筑简粮纷索绿编缓缩总绩继纤罚罗义习圣声职肿胆临举旧舰艺节盖荐处虚虫术补装制见规觉触计订训记许访评词试询该详语认志调论咨证识议让"
    "负财贡贫购贵买贺宾赏赔卖赖赛赞赠趋跃践辅轻载辑较转办边还过适选遗邻酱释针钙钛表键镀锁镜长闪闭问闲阅队阴阳阶际险随双鸡云雾静韵项须预领头频颗愿顾饭饮馆驻驱腾惊发斗鱼鲜鸟丽麦党齐齿龟荣")
_T2S = {ord(a): b for a, b in zip(TRADITIONAL, SIMPLIFIED) if a != b}
_HAS = re.compile("[" + "".join(sorted({chr(k) for k in _T2S})) + "]")


def simplified(t: str) -> str:
    return t.translate(_T2S) if _HAS.search(t) else t


def folded(t: str) -> str:
    """Half width, simplified script, one form for each character."""
    return simplified(unicodedata.normalize("NFKC", t))


_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_UNIT = {"十": 10, "百": 100, "千": 1000}


def numeral(s: str) -> int | None:
    """The number a Chinese numeral below ten thousand stands for."""
    if not s or any(c not in _DIGIT and c not in _UNIT for c in s):
        return None
    if all(c in _DIGIT for c in s):
        return int("".join(str(_DIGIT[c]) for c in s))
    total, digit = 0, 0
    for c in s:
        if c in _DIGIT:
            digit = _DIGIT[c]
        else:
            total += (digit or 1) * _UNIT[c]
            digit = 0
    return total + digit


# Level 1 of the GB 2312 character set is in the order of pinyin; where each syllable begins, as code - 65536.
SYLLABLES = """
a -20319 ai -20317 an -20304 ang -20295 ao -20292 ba -20283 bai -20265 ban -20257 bang -20242 bao -20230 bei -20051 ben -20036 beng -20032 bi -20026
bian -20002 biao -19990 bie -19986 bin -19982 bing -19976 bo -19805 bu -19784 ca -19775 cai -19774 can -19763 cang -19756 cao -19751 ce -19746
ceng -19741 cha -19739 chai -19728 chan -19725 chang -19715 chao -19540 che -19531 chen -19525 cheng -19515 chi -19500 chong -19484 chou -19479
chu -19467 chuai -19289 chuan -19288 chuang -19281 chui -19275 chun -19270 chuo -19263 ci -19261 cong -19249 cou -19243 cu -19242 cuan -19238
cui -19235 cun -19227 cuo -19224 da -19218 dai -19212 dan -19038 dang -19023 dao -19018 de -19006 deng -19003 di -18996 dian -18977 diao -18961
die -18952 ding -18783 diu -18774 dong -18773 dou -18763 du -18756 duan -18741 dui -18735 dun -18731 duo -18722 e -18710 en -18697 er -18696
fa -18526 fan -18518 fang -18501 fei -18490 fen -18478 feng -18463 fo -18448 fou -18447 fu -18446 ga -18239 gai -18237 gan -18231 gang -18220
gao -18211 ge -18201 gei -18184 gen -18183 geng -18181 gong -18012 gou -17997 gu -17988 gua -17970 guai -17964 guan -17961 guang -17950 gui -17947
gun -17931 guo -17928 ha -17922 hai -17759 han -17752 hang -17733 hao -17730 he -17721 hei -17703 hen -17701 heng -17697 hong -17692 hou -17683
hu -17676 hua -17496 huai -17487 huan -17482 huang -17468 hui -17454 hun -17433 huo -17427 ji -17417 jia -17202 jian -17185 jiang -16983 jiao -16970
jie -16942 jin -16915 jing -16733 jiong -16708 jiu -16706 ju -16689 juan -16664 jue -16657 jun -16647 ka -16474 kai -16470 kan -16465 kang -16459
kao -16452 ke -16448 ken -16433 keng -16429 kong -16427 kou -16423 ku -16419 kua -16412 kuai -16407 kuan -16403 kuang -16401 kui -16393 kun -16220
kuo -16216 la -16212 lai -16205 lan -16202 lang -16187 lao -16180 le -16171 lei -16169 leng -16158 li -16155 lia -15959 lian -15958 liang -15944
liao -15933 lie -15920 lin -15915 ling -15903 liu -15889 long -15878 lou -15707 lu -15701 lv -15681 luan -15667 lue -15661 lun -15659 luo -15652
ma -15640 mai -15631 man -15625 mang -15454 mao -15448 me -15436 mei -15435 men -15419 meng -15416 mi -15408 mian -15394 miao -15385 mie -15377
min -15375 ming -15369 miu -15363 mo -15362 mou -15183 mu -15180 na -15165 nai -15158 nan -15153 nang -15150 nao -15149 ne -15144 nei -15143
nen -15141 neng -15140 ni -15139 nian -15128 niang -15121 niao -15119 nie -15117 nin -15110 ning -15109 niu -14941 nong -14937 nu -14933 nv -14930
nuan -14929 nue -14928 nuo -14926 o -14922 ou -14921 pa -14914 pai -14908 pan -14902 pang -14894 pao -14889 pei -14882 pen -14873 peng -14871
pi -14857 pian -14678 piao -14674 pie -14670 pin -14668 ping -14663 po -14654 pu -14645 qi -14630 qia -14594 qian -14429 qiang -14407 qiao -14399
qie -14384 qin -14379 qing -14368 qiong -14355 qiu -14353 qu -14345 quan -14170 que -14159 qun -14151 ran -14149 rang -14145 rao -14140 re -14137
ren -14135 reng -14125 ri -14123 rong -14122 rou -14112 ru -14109 ruan -14099 rui -14097 run -14094 ruo -14092 sa -14090 sai -14087 san -14083
sang -13917 sao -13914 se -13910 sen -13907 seng -13906 sha -13905 shai -13896 shan -13894 shang -13878 shao -13870 she -13859 shen -13847
sheng -13831 shi -13658 shou -13611 shu -13601 shua -13406 shuai -13404 shuan -13400 shuang -13398 shui -13395 shun -13391 shuo -13387 si -13383
song -13367 sou -13359 su -13356 suan -13343 sui -13340 sun -13329 suo -13326 ta -13318 tai -13147 tan -13138 tang -13120 tao -13107 te -13096
teng -13095 ti -13091 tian -13076 tiao -13068 tie -13063 ting -13060 tong -12888 tou -12875 tu -12871 tuan -12860 tui -12858 tun -12852 tuo -12849
wa -12838 wai -12831 wan -12829 wang -12812 wei -12802 wen -12607 weng -12597 wo -12594 wu -12585 xi -12556 xia -12359 xian -12346 xiang -12320
xiao -12300 xie -12120 xin -12099 xing -12089 xiong -12074 xiu -12067 xu -12058 xuan -12039 xue -11867 xun -11861 ya -11847 yan -11831 yang -11798
yao -11781 ye -11604 yi -11589 yin -11536 ying -11358 yo -11340 yong -11339 you -11324 yu -11303 yuan -11097 yue -11077 yun -11067 za -11055
zai -11052 zan -11045 zang -11041 zao -11038 ze -11024 zei -11020 zen -11019 zeng -11018 zha -11014 zhai -10838 zhan -10832 zhang -10815 zhao -10800
zhe -10790 zhen -10780 zheng -10764 zhi -10587 zhong -10544 zhou -10533 zhu -10519 zhua -10331 zhuai -10329 zhuan -10328 zhuang -10322 zhui -10315
zhun -10309 zhuo -10307 zi -10296 zong -10281 zou -10274 zu -10270 zuan -10262 zui -10260 zun -10256 zuo -10254
""".split()
# Readings of characters outside level 1, and other readings of some inside.
OTHER = (
    "崧 song 漪 yi 浔 xun 霁 ji 珞 luo 蕖 qu 溆 xu 芷 zhi 璟 jing 睿 rui 鑫 xin 怡 yi 瀚 han 珂 ke 滕 teng 锵 qiang 璨 can 铠 kai 箬 ruo 嗯 en 淞 song 芸 yun 寰 huan 皓 hao 骅 hua 桉 an 曦 xi "
    "垠 yin 唑 zuo 腱 jian 潇 xiao 曜 yao 萱 xuan 璧 bi 楠 nan 梓 zi 忒 te 瑕 xia 昊 hao 晖 hui 晟 sheng 钰 yu 琪 qi 瑾 jin 瑜 yu 琳 lin 琦 qi 珺 jun 玥 yue 琛 chen 璇 xuan 璐 lu 瑶 yao 祺 qi 祎 yi 嵘 rong 峥 zheng 嵩 song 岚 lan "
    "岱 dai 岷 min 泓 hong 泫 xuan 洺 ming 浚 jun 涵 han 淼 miao 渝 yu 湘 xiang 溢 yi 滢 ying 澍 shu 澜 lan 濠 hao 瀛 ying 炜 wei 炫 xuan 焱 yan 煜 yu 熠 yi 燊 shen 犇 ben 斌 bin 旻 min 昕 xin 昱 yu 晗 han 暄 xuan "
    "柏 bo 桦 hua 梵 fan 榕 rong 槿 jin 樊 fan 骏 jun 骁 xiao 骐 qi 骥 ji 飒 sa 馨 xin 黛 dai 彧 yu 妤 yu 嘉 jia 轩 xuan 宸 chen 宥 you 寅 yin 尧 yao 亓 qi 佟 tong 佳 jia 俪 li 倩 qian 偲 si 傲 ao 勋 xun 匡 kuang 卓 zhuo "
    "翊 yi 翎 ling 翌 yi 羿 yi 聿 yu 艺 yi 芊 qian 芃 peng 苒 ran 茗 ming 荃 quan 莘 shen 莹 ying 菁 jing 菡 han 萌 meng 葳 wei 蓓 bei 蔚 wei 蕊 rui 薇 wei 蕙 hui 蘅 heng 赟 yun 逸 yi 邺 ye 邹 zou 郢 ying 钊 zhao 钧 jun "
    "锟 kun 镕 rong 闵 min 阙 que 隽 jun 霏 fei 霖 lin 颢 hao 麒 qi 麟 lin 禧 xi 稷 ji 筠 yun 绮 qi 缪 miao").split()
READINGS = {"重": "chong", "乐": "yue", "盛": "cheng", "长": "zhang", "行": "xing", "朝": "zhao", "单": "shan", "曾": "ceng", "沈": "chen", "解": "xie", "藏": "zang", "调": "diao", "传": "zhuan", "石": "dan", "厦": "sha", "大": "dai", "都": "dou", "和": "huo", "合": "ge", "降": "xiang", "强": "jiang", "仇": "qiu", "柏": "bai", "泊": "po", "翟": "di", "会": "kuai", "佛": "fu", "广": "an", "度": "duo", "万": "mo", "卡": "qia", "薄": "bao", "车": "ju", "折": "she", "系": "ji", "省": "xing", "俞": "shu", "尉": "yu", "种": "chong", "轧": "zha"}
DEFAULTS = {"重": "zhong", "乐": "le", "盛": "sheng", "长": "chang", "行": "hang", "朝": "chao", "大": "da", "都": "du", "和": "he", "合": "he", "降": "jiang", "强": "qiang", "广": "guang", "万": "wan", "度": "du", "车": "che", "折": "zhe", "系": "xi", "省": "sheng", "会": "hui", "佛": "fo", "单": "dan", "曾": "zeng", "传": "chuan", "石": "shi", "种": "zhong", "卡": "ka"}


def _table() -> dict[str, str]:
    names, begins = SYLLABLES[::2], [int(x) + 65536 for x in SYLLABLES[1::2]]
    out: dict[str, str] = {}
    k = 0
    for code in range(begins[0], 0xD7FA):
        if code & 0xFF < 0xA1 or code & 0xFF == 0xFF:
            continue
        while k + 1 < len(begins) and code >= begins[k + 1]:
            k += 1
        try:
            out[bytes((code >> 8, code & 0xFF)).decode("gb2312")] = names[k]
        except UnicodeDecodeError:
            continue
    out |= dict(zip(OTHER[::2], OTHER[1::2]))
    return out | DEFAULTS


_PINYIN: dict[str, str] = {}


def pinyin(c: str) -> str:
    """The syllable of one character, without tone; the character itself where it is unknown."""
    if not _PINYIN:
        _PINYIN.update(_table())
    return _PINYIN.get(c, c)


def syllables(t: str) -> list[str]:
    return [pinyin(c) for c in t]


def near(a: str, b: str) -> bool:
    """Whether two syllables are typed for one another: the same, or apart only in a front or back nasal or a flat or curled initial."""
    if a == b:
        return True
    f = lambda s: re.sub(r"^([zcs])h", r"\1", re.sub(r"([aei]n)g$", r"\1", s))
    return f(a) == f(b)


def sounds(c: str) -> set[str]:
    return {pinyin(c), READINGS.get(c, pinyin(c))}


def same_sound(a: str, b: str) -> bool:
    """Whether two characters share a reading."""
    return a == b or bool(sounds(a) & sounds(b))


_CLASS: dict[str, str] = {}


def plain_sound(s: str) -> str:
    """A syllable or word without the differences of close sounds: front and back nasals, flat and curled initials."""
    return re.sub(r"([aei]n)g(?![aeiou])", r"\1", re.sub(r"([zcs])h", r"\1", s))


def sound_class(c: str) -> str:
    """One name for all characters that may share a sound, directly or by way of characters with several readings."""
    if not _CLASS:
        for x, r in READINGS.items():
            a, b = (_root(plain_sound(y)) for y in (r, pinyin(x)))
            if a != b:
                _CLASS[max(a, b)] = min(a, b)
    return _root(plain_sound(pinyin(c)))


def _root(s: str) -> str:
    while s in _CLASS:
        s = _CLASS[s]
    return s
