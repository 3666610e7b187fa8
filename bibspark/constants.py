"""Word lists, names, thresholds and tables that results depend on. Stated as they are, in natural order."""

ENGLISH_STOPWORDS = """
the a an and or in on at to for of with by from is are was were be been being have has had do does did will would
could should may might must shall can need dare ought used this that these those it its i you he she we they me him
her us them my your his our their not no nor so than too very just also then now here there where when why which who
whom what how all both each few more most other some such only own same as if because about into
""".split()

ROMANCE_STOPWORDS = """
de la le les du des un une el los las al del y o en para por con sin sobre entre a e do da das dos no na nas nos em
ao aos à às como quando onde qual quais quem muito mais menos bem mal já ainda também tambem assim mesmo mesma
""".split()

CJK_STOP_CHARS = list("的了和与及或是在我你他她它这那有不没就都也还又再很更最被把让给从向往由以于因为如若虽但而且并等啊吗呢吧呀哦嗯之其此彼")

CJK_STOP_WORDS = """
一个 一些 一样 一定 一起 一直 已经 可以 但是 因为 所以 虽然 如果 即使 只要 只有 关于 对于 为了 按照 通过 根据 以及 而且 或者 还是 不是
没有 不能 不会 不要 不可 什么 怎么 为什么 哪里 哪个 哪些 谁的 现在 以前 以后 当时 同时 然后 最后 首先
""".split()

TITLE_SUFFIXES = """
珍藏版 典藏版 修订版 新版 精装版 平装版 全集 选集 合集 套装 上下册 全册 完整版 精简版 插图版 注释版 导读版 纪念版 限量版 第一版 第二版
第三版 增订版 补编版 译文版 原版 影印版 扫描版 电子版 网络版 试行版
""".split()

AUTHOR_ROLES = "著 编 译 注 主编 校对 注释 编写 编著 编译 译注 审校 校注 整理 改编 口述 执笔 绘 画 摄影 篆刻 书".split()

#: Tried in this order; the first that occurs splits the name.
AUTHOR_SEPARATORS = ["，", ",", "、", ";", "；", "和", "与", "及", "等", "/", "\\"]

PUNCTUATION = "《》【】[]()（）{}<>〈〉「」『』、，。；：\"'！？·—…～-/\\|`~@#$%^&*+="

#: Of the fingerprint's stopwords only words and single characters can ever meet a token.
SIMHASH_STOPWORDS = """
the a an and or in on at to for of with by from is are was were be been being have has had do does did will would
could should may might must shall mustn don didn wasn weren this that these those it its i you he she we they me him
her us them my your his our their not no nor so than too very just also then now here there where when why which who
whom whose what how all both each few more most other some such only own same de la le les du des un une el los las al
del y o en para por con sin sobre entre da das dos na nas nos em ao aos à às do com sem
""".split()

SIMHASH_STOP_CHARS = list("的是在了和与及或这那我你他她它谁哪就都也还又再很更最不没有要会能")

PSEUDONYMS = [
    ["鲁迅", "周树人"], ["老舍", "舒庆春"], ["巴金", "李尧棠"], ["茅盾", "沈德鸿"], ["曹禺", "万家宝"], ["郭沫若", "郭开贞"],
    ["冰心", "谢婉莹"], ["沈从文", "沈岳焕"], ["钱钟书", "钱锺书", "钱仰先"], ["张爱玲", "张煐"], ["金庸", "查良镛"],
    ["古龙", "熊耀华"], ["琼瑶", "陈喆"], ["三毛", "陈懋平", "陈平"], ["莫言", "管谟业"], ["余华"], ["路遥", "王卫国"],
    ["陈忠实"], ["贾平凹"], ["刘慈欣"], ["郝景芳"],
]

SUSPICIOUS_PAIRS = [
    ("余华", "余秋雨"), ("余华", "余杰"), ("余华", "余平"), ("鲁迅", "鲁"), ("鲁迅", "迅"), ("路遥", "路"), ("路遥", "遥远"),
    ("路遥", "路遥远"), ("刘慈欣", "慈欣"), ("刘慈欣", "刘欣"), ("刘慈欣", "刘慈"), ("张爱玲", "爱玲"), ("钱钟书", "钟书"),
    ("沈从文", "从文"), ("巴金", "巴金金"), ("老舍", "老"), ("冰心", "冰"), ("莫言", "莫"),
]

FORMAT_SCORES = {"epub": 1.0, "pdf": 0.9, "mobi": 0.7, "azw3": 0.6, "azw": 0.5, "txt": 0.8, "docx": 0.5, "doc": 0.4}
OTHER_FORMAT_SCORE = 0.3

CONVERSIONS = {"epub": ["azw3", "mobi", "pdf", "txt"], "mobi": ["azw3", "epub", "pdf", "txt"], "pdf": ["epub", "mobi", "txt"], "azw3": ["epub", "mobi", "pdf", "txt"]}

BAD_NAME_WORDS = ["副本", "copy", "备份", "backup", "untitled", "无标题", "新建", "new", "download", "下载", "temp", "临时"]

EXTENSIONS = [".epub", ".mobi", ".pdf"]

MATCH_LABELS = {"isbn_exact": "📚 ISBN精确", "title_author_simhash": "📖 书名+内容", "simhash_content": "📝 内容相似", "fuzzy_match": "🔍 模糊匹配"}

REASON_SAME_ISBN = "ISBN精确匹配"
REASON_PSEUDONYM = "已知笔名/别名匹配"
REASON_SUSPICIOUS = "⚠️ 可疑相似作者名组合，作者匹配度降权至 {}%"
REASON_AUTHOR_OK, REASON_AUTHOR_BAD = "作者匹配度 {}%", "作者差异大，匹配度仅 {}%"
REASON_TITLE_OK, REASON_TITLE_BAD = "书名匹配度 {}%", "书名匹配不足 {}%"
REASON_OTHER_AUTHOR = "❌ 作者名完全不同，疑似不同书"
KEEP_FORMAT, KEEP_METADATA, KEEP_SIZE, KEEP_COVER, KEEP_TEXT = "格式通用 ({})", "元数据完整", "体积适中", "包含封面", "正文完整"
DROP_METADATA, DROP_FORMAT, DROP_LARGE, DROP_SMALL, DROP_COVER = "元数据较少", "格式较不通用 ({})", "体积过大", "可能是压缩版/删减版", "缺少封面"

OVERALL_WEIGHTS = {"isbn": 0.15, "author": 0.60, "title": 0.12, "simhash": 0.10, "size": 0.03}
KEEP_WEIGHTS = {"metadata": 0.35, "format": 0.25, "size": 0.20, "quality": 0.15, "filename": 0.05}


def longest_first(words: list[str]) -> list[str]:
    """Order in which overlapping words are removed: length, then code point."""
    return sorted(set(words), key=lambda w: (-len(w), w))
