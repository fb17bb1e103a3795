"""Language packs: how texts are cut, and which expressions count."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from .segment import Segmenter


@dataclass(frozen=True)
class Pack:
    name: str
    paragraph: str  # between paragraphs
    least_paragraph: int  # characters that a paragraph must exceed
    sentence: str  # between sentences
    least_sentence: int
    token: str  # unless a cutter is given
    connectors: dict[str, list[str]]
    slop: dict[str, list[str]]
    stopwords: list[str]
    term: str  # a token that is a term
    templates: list[tuple[list[str], float]] = field(default_factory=list)
    starters: list[str] = field(default_factory=list)
    formulas: list[tuple[str, float, str]] = field(default_factory=list)
    references: str = r"^\s*(?:References|Bibliography)"
    edge: str = "[。！？；]"  # between sentences where paragraphs meet
    concept: str = "[一-鿿]{3,}"
    guard: bool = False  # whether signs of a human hand lower levels
    cutter: Segmenter | None = None  # cuts texts without spaces between words

    @property
    def dense_slop(self) -> list[str]:
        return [p for k in ("overused_phrases", "empty_modifiers", "ai_conclusion_starters") for p in self.slop.get(k, [])]

    @property
    def all_slop(self) -> list[str]:
        return list(dict.fromkeys(p for own in self.slop.values() for p in own))

    @property
    def all_connectors(self) -> list[str]:
        return [p for own in self.connectors.values() for p in own]


# The expressions of the Chinese pack, as they must be for equal results.
ZH = Pack(
    name="zh",
    paragraph=r"\n\s*\n",
    least_paragraph=10,
    sentence="[。！？；!?;]+",
    least_sentence=2,
    token="",  # a dictionary cuts, below
    connectors={
        "high": ["值得注意的是", "不可忽视的是", "需要指出的是", "需要强调的是", "不容忽视的是", "与此同时", "从某种意义上说", "在此基础上", "在这一背景下", "从这个角度来看", "就目前而言", "在某种程度上", "从根本上说", "毫无疑问", "不言而喻"],
        "medium": ["因此", "然而", "此外", "首先", "其次", "最后", "再次", "进而", "从而", "综上所述", "总而言之", "换言之", "也就是说", "这表明", "这意味着"],
        "low": ["并且", "而且", "但是", "所以", "因为", "如果", "虽然", "尽管", "不过", "同时", "另外", "随后", "接着", "之后", "此前"],
    },
    slop={
        "overused_phrases": [
            "具有重要的理论意义和现实意义", "为推动...提供了有力支撑", "在...方面发挥着重要作用", "已成为...领域的研究热点", "引起了学术界和工业界的广泛关注", "对于...具有重要的参考价值",
            "为后续研究奠定了坚实的基础", "具有良好的应用前景", "有待进一步研究", "仍需深入探讨", "取得了显著的研究进展", "呈现出良好的发展态势", "面临着前所未有的机遇和挑战",
            "从...到...的转变", "实现了...的跨越式发展", "深刻改变了...的格局", "正在深刻改变", "已成为不可逆转的趋势",
        ],
        "template_structures": ["不仅...而且...同时...", "一方面...另一方面...", "首先...其次...最后...", "从...的角度来看", "在...的背景下", "基于...的分析", "通过...的研究", "结合...的实际", "针对...的问题", "围绕...这一核心"],
        "empty_modifiers": ["至关重要", "不可或缺", "不可替代", "举足轻重", "意义深远", "影响广泛", "作用巨大", "效果显著", "优势明显", "前景广阔", "潜力巨大"],
        "ai_conclusion_starters": ["综上所述", "总而言之", "概括而言", "综合来看", "整体而言", "归纳起来", "总体说来", "从以上分析可以看出"],
        "ai_transition_sets": ["一方面...另一方面...", "不仅...而且...此外...", "首先...其次...再次...最后...", "从微观...到宏观...", "从理论...到实践...", "从国内...到国际...", "从短期...到长期..."],
    },
    stopwords=[
        "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一",
        "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
        "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些",
        "所", "为", "所以", "因为", "但是", "然而", "如果", "虽然", "可以",
        "这个", "那个", "什么", "怎么", "哪", "吗", "啊", "吧", "呢", "哦",
        "的", "地", "得", "之", "与", "及", "或", "对", "等", "从", "到",
        "向", "往", "朝", "在", "当", "为", "以", "就", "才", "刚", "已",
        "将", "要", "能", "会", "可", "该", "应", "用", "把", "被", "让",
        "给", "经", "过", "于", "按", "照", "依", "据", "靠", "沿", "顺",
    ],
    term="^[一-鿿]{3,}$",
    templates=[
        (["首先", "其次", "最后"], 0.40),
        (["首先", "其次", "此外"], 0.35),
        (["一方面", "另一方面"], 0.30),
        (["从.*来看", "从.*来看", "从.*来看"], 0.35),
        (["不仅", "而且", "同时"], 0.30),
    ],
    starters=["^.{0,4}?(通过|借助|依靠|经由|基于|将|把|对|由|因|按|沿|顺|朝|向|往)", "^.{0,4}?(从|以|在)"],
    formulas=[
        ("本文从.{2,20}(?:角度|维度|方面|层面|路径).{0,10}(?:分析|探讨|研究|考察|阐述|揭示)", 0.15, "学术开头"),
        ("(?:通过|借助|经由|以).{2,20}(?:将|使|让|令|把)", 0.12, "手段-结果句式"),
        ("(?:最终|总之|综上|由此).{0,10}(?:成就|可见|表明|说明|体现|造就)", 0.12, "学术结尾"),
        ("(?:不仅|不只).{2,30}(?:而且|也|还|更|进而|同时)", 0.10, "递进句式"),
    ],
    references=r"^\s*(?:参考文献|参考书目|References|Bibliography|引用文献|参考资料)",
    guard=True,
)

#: Signs that are mostly words by themselves; this library's own choice.
ALONE = "的了在是和就都也很着吗啊吧呢与及或把被我你他她它这那"
#: Words of three signs and more, and some of two, that texts on research often have; this library's own choice, to be widened by with_words().
COMMON = ["我们", "他们", "它们", "可能", "地方", "对象", "应用", "过程", "经济", "好处", "看法", "会议", "有效", "不同", "一些", "于是", "以及", "上述", "研究者", "方法论", "可持续", "参与者", "重要性", "可能性", "必要性", "有效性", "人工智能", "机器学习", "社会科学", "自然科学", "基础设施", "公共服务", "信息技术", "数字化", "现代化", "一体化", "参考文献", "关键词"]


#: How often a word of these lists is taken to stand in a text that has every sign once for each word; this library's own choice.
KNOWN, MOSTLY_ALONE = 50, 400


def with_frequencies(pack: Pack, frequencies: Mapping[str, int]) -> Pack:
    """The pack with its words cut by a dictionary: words and how often they stand in texts (readers.dictionary(), operators.lexicons.learn())."""
    return replace(pack, cutter=Segmenter(frequencies))


def with_words(pack: Pack, words: Iterable[str]) -> Pack:
    """The pack with further words for cutting texts, such as the terms of a discipline, each as frequent as the pack's own."""
    whole = [*pack.all_connectors, *(part for p in pack.all_slop for part in p.split("...") if len(part) > 1), *pack.stopwords, *COMMON, *words]
    own = dict.fromkeys(whole, KNOWN)
    return with_frequencies(pack, own | dict.fromkeys(ALONE, MOSTLY_ALONE))


ZH = with_words(ZH, [])

#: For texts in European languages, of one line a paragraph. The lists are this library's own.
LATIN = Pack(
    name="latin",
    paragraph=r"\n+",
    least_paragraph=10,
    sentence=r"[.!?;\n]+",
    least_sentence=2,
    token="[0-9a-zà-öø-ÿœß]+",
    connectors={
        "high": ["it should be noted", "it is worth noting", "in this context", "first and foremost", "es ist anzumerken", "in diesem Zusammenhang", "il convient de noter", "dans ce contexte", "cabe señalar", "en este contexto"],
        "medium": ["Therefore", "therefore", "However", "however", "Moreover", "Furthermore", "Consequently", "Daher", "daher", "Jedoch", "jedoch", "Darüber hinaus", "Cependant", "cependant", "En outre", "Por lo tanto", "Sin embargo", "Además"],
        "low": [" but ", " because ", " although ", " while ", " then ", " aber ", " weil ", " obwohl ", " mais ", " car ", " parce que ", " puis ", " pero ", " porque ", " aunque ", " entonces "],
    },
    slop={
        "overused_phrases": ["plays a crucial role", "of great importance", "has attracted attention", "lays the foundation", "spielt eine wichtige Rolle", "von großer Bedeutung", "joue un rôle essentiel", "d'une grande importance", "desempeña un papel fundamental", "de gran importancia"],
        "empty_modifiers": ["crucial", "indispensable", "unprecedented", "entscheidend", "unverzichtbar", "incontournable", "imprescindible"],
        "ai_conclusion_starters": ["In conclusion", "In summary", "To sum up", "Zusammenfassend", "En conclusion", "En résumé", "En resumen"],
        "template_structures": ["not only", "from the perspective of", "aus der Sicht", "du point de vue", "desde el punto de vista"],
        "ai_transition_sets": ["On the one hand", "On the other hand", "Einerseits", "Andererseits", "D'une part", "D'autre part", "Por un lado", "Por otro lado"],
    },
    stopwords=[
        "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as", "be", "by", "this", "was", "are", "at", "from",
        "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "auf", "für", "sich",
        "le", "la", "les", "de", "des", "et", "un", "une", "que", "dans", "est", "du",
        "el", "los", "las", "y", "en", "con", "por", "una", "se",
    ],
    term="^[a-zà-öø-ÿœß]{9,}$",
    templates=[
        (["First", "Second", "Finally"], 0.40),
        (["[Oo]n the one hand", "[Oo]n the other hand"], 0.30),
        (["not only", "but also"], 0.30),
        (["[Ee]inerseits", "[Aa]ndererseits"], 0.30),
        (["[Dd]'une part", "[Dd]'autre part"], 0.30),
        (["[Pp]or un lado", "[Pp]or otro lado"], 0.30),
    ],
    starters=["^.{0,4}?(By|Through|With|Durch|Mit|Par|Avec|Por|Con) ", "^.{0,4}?(In|On|The|Der|Die|Das|Le|La|El|En) "],
    formulas=[("(?:[Tt]his|[Oo]ur) (?:paper|study|article) .{0,20}(?:examines|explores|analyses|analyzes)", 0.15, "opening"), ("(?:not only|nicht nur|non seulement|no solo) .{2,30}(?:but|sondern|mais|sino)", 0.10, "progression")],
    edge="[.!?;]",
    concept="[a-zà-öø-ÿœß]{6,}",
)

#: Signs whose spread is measured.
PUNCTUATION = "，。！？；：、\"（）《》【】…—·,.!?;:'()[]{}"
