"""Patterns and word lists of the highlight engine, and their translation to Java regular expressions.

The patterns are written with word boundaries of ASCII words and with a wide class of white space. Java's
own classes depend on the JDK, so java() spells both out.
"""

from __future__ import annotations

import unicodedata

# Fixed: white space that counts, as members of a class.
SPACES = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"
#: The same characters, and the marks that go with them in front of and behind a range.
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
OPENING, CLOSING = "\"'([{", "\"')]}"
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Phrase patterns with their scores, in the order of evaluation; all ignore ASCII case but where noted.
POSITIVE = (
    (r"\b(we (propose|present|introduce|show|find|demonstrate|observe|report))\b", 4),
    (r"\b(outperform|improv(?:e|es|ed)|better than|state-of-the-art|sota|significant(?:ly)?)\b", 4),
    (r"\b(result|results|finding|findings|evidence|achiev(?:e|es|ed)|yield(?:s|ed)?)\b", 3),
    (r"\b(limit(?:ation|ations)?|caveat|however|fails?|failure|underperform|boundary|scope|trade-?off)\b", 3),
    (r"\b(problem|challenge|gap|remains|unclear|little is known|motivat(?:e|es|ion))\b", 2),
    (r"\b(method|architecture|training|dataset|evaluation|ablat(?:ion|e)|benchmark|protocol|pipeline)\b", 2),
    (r"\b(precision|recall|f1|accuracy|auc|bleu|rouge|percent|%)\b", 2),
    (r"\b(novel|contribution|contributions|first to|we argue|we claim|our work)\b", 2),
)
NEGATIVE = (
    (r"\b(Fig\.?|Figure|Table|Eq\.?|Equation|Appendix|appendix)\b", -5),
    (r"\bet al\.", -2),
    (r"\b(this|these|it|they|such)\b", -1),
    (r"\b(related work|in this section|the rest of the paper|as shown in)\b", -4),
    (r"\[[0-9,\-\s]+\]", -2),
    (r"\([^)]*\d{4}[^)]*\)", -2),
    (r"\bdoi\b|https?:\/\/", -4),
)
# Fixed: reasons and their patterns, in the order of their tests.
REASONS = (
    ("result", r"\b(result|results|finding|findings|outperform|improv(?:e|es|ed)|accuracy|f1|precision|recall|auc|bleu|rouge|significant|increase|decrease|gain|achiev(?:e|es|ed)|yield(?:s|ed)?)\b"),
    ("method", r"\b(method|approach|architecture|model|dataset|training|fine-tun|pretrain|benchmark|pipeline|framework|protocol|setup|procedure|algorithm)\b"),
    ("caveat", r"\b(limit(?:ation|ations)?|caveat|however|although|despite|drawback|shortcoming|risk|bias|concern|fails?|failure|scope|boundary|trade-?off)\b"),
    ("claim", r"\b(we propose|we present|we introduce|we argue|we claim|our contribution|contribution|novel|first to|this paper|we show)\b"),
    ("background", r"\b(problem|challenge|gap|motivat(?:e|es|ion)|prior work|previous work|related work|background|existing work|little is known)\b"),
)
SECTION_REASONS = {"results": "result", "methods": "method", "discussion": "caveat", "abstract": "claim", "conclusion": "claim"}
# Fixed: patterns of citations, pronouns, numbers, captions and references, and characters at which text is cut.
CITATION_SQUARE = r"\[[0-9,\-\s]+\]"
CITATION_YEAR = r"\([^)]*\d{4}[^)]*\)"
PRONOUNS = r"\b(this|these|it|they|such|former|latter)\b"
NUMERIC = r"\b\d+(?:\.\d+)?(?:\s?%|\s?(?:x|times|fold|ms|s|sec|seconds|minutes|hours|k|m|b))?\b"
FIRST_PERSON = r"^\s*(we|our)\b"
CAPTION = r"^(figure|table|equation|appendix)\b"
REFERENCE_HEADING = "^(references|bibliography|works cited|参考文献|參考文獻|参考資料|參考資料|文献|文獻)$"
REFERENCE_ENTRY = r"^\s*(\[[0-9]+\]|[\p{Lu}\p{L}][\p{L}'`-]+,\s+[\p{Lu}]\.|[\p{Lu}\p{L}][\p{L}'`-]+\s+et al\.)"
REFERENCE_PAGES = r"\b(pp?\.?\s*\d+|vol\.?\s*\d+|no\.?\s*\d+)\b"
SENTENCE_START = "\\p{L}\\p{N}(\\[{\"'“”‘’「『（【《"
ASCII_END, CJK_END = ".!?", "。！？；："
SPLIT_MARKS = ";:；：,，、"
SPLIT_CONNECTORS = r"(?:,\s+(?:but|while|whereas|however|therefore)|，(?:但|而|并且|同時|同时|然而|因此)|、(?:しかし|そして|また))"
HEADING_LINE = r"^[\p{L}\p{N}\s()\-–—/:：&+,，、]+$"
HEADING_PREFIX = r"^[\p{N}\s.．、,，:：()（）\[\]【】-]+"
# Fixed: terms by kind of section, in the order of their tests.
SECTION_TERMS = (
    ("abstract", ("abstract", "summary", "摘要", "要旨", "초록", "요약")),
    ("introduction", ("introduction", "background", "引言", "绪论", "緒論", "背景", "서론", "소개")),
    ("related-work", ("related work", "prior work", "related studies", "相关工作", "相關工作", "先行研究", "관련 연구")),
    ("methods", ("method", "methods", "approach", "model", "setup", "方法", "方法论", "方法論", "模型", "手法", "방법")),
    ("results", ("result", "results", "evaluation", "experiment", "experiments", "结果", "結果", "实验", "實驗", "評価", "실험", "결과")),
    ("discussion", ("discussion", "analysis", "limitation", "limitations", "讨论", "討論", "分析", "局限", "局限性", "考察", "논의", "한계")),
    ("conclusion", ("conclusion", "conclusions", "结论", "結論", "まとめ", "결론")),
    ("references", ("reference", "references", "bibliography", "works cited", "参考文献", "參考文獻", "参考資料", "參考資料", "文献", "文獻")),
)
# Fixed: words that are no terms.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "had", "has", "have", "in", "into", "is", "it",
    "its", "of", "on", "or", "that", "the", "their", "there", "these", "this", "those", "to", "was", "were", "with", "we", "our", "you",
    "your", "they", "them", "he", "she", "his", "her", "than", "then", "which", "while", "where", "when", "what", "how", "can", "could",
    "should", "would", "may", "might", "must", "will", "also", "using", "used", "use", "based", "paper", "study", "results", "method",
    "methods", "approach", "model", "models", "data", "task", "tasks", "show", "shows", "shown", "find", "finds", "found", "propose",
    "present", "introduce", "new", "via", "over", "under", "between", "within", "across", "after", "before", "during", "through",
    "more", "most", "less", "many", "much", "other", "than", "such", "each", "both", "all", "any", "some", "few", "do", "does", "did",
    "not", "no", "yes", "if", "but", "however", "because", "due", "than", "thus", "therefore", "toward", "towards", "per",
)

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_SEA = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_JOIN = r"\p{M}\u200c\u200d"
#: Letters of Latin scripts are told by their ranges, scripts of others are looked up.
_LETTER = rf"[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F[\p{{L}}\p{{N}}&&[\u0000-\uFFFF]&&[^{_CJK}{_SEA}]]]"
#: A run of a script without blanks is one token; else letters and digits, with - and ' before a letter or digit.
RUN = rf"[{_CJK}][{_CJK}{_JOIN}]*|[{_SEA}][{_SEA}{_JOIN}]*"


def singles(chars: str) -> str:
    """Members of a class below U+0100 one by one: Java looks these up in one table, ranges one after another."""
    return "".join(f"\\x{ord(c):02x}" for c in chars)


LATIN = "".join(map(chr, range(256)))
#: Letters and digits below U+0100, and a token of text that has no character above.
LATIN_LETTERS = singles("".join(c for c in LATIN if unicodedata.category(c)[0] in "LN"))
LATIN_TOKEN = f"[{LATIN_LETTERS}]+(?:[-'][{LATIN_LETTERS}]+)*"
#: Of the same text: white space that is more than one blank, and what is no part of a key.
LATIN_BLANKS = r"[\t\n\x0b\f\r \xa0]{2,}|[\t\n\x0b\f\r\xa0]"
LATIN_MARKS = f"[^{LATIN_LETTERS}% ]+"
TOKEN = rf"{_LETTER}+(?:[-'](?=[\p{{L}}\p{{N}}]){_LETTER}*)*|(?![\x00-\u024F])(?:{RUN})"


def _first(pattern: str) -> str:
    """A look-ahead for the first characters of a pattern that begins with a boundary, tried before the boundary is; empty where an alternative begins with more than a letter or digit."""
    body = pattern[2:]
    grouped = body.startswith("(")
    found, depth, start = [], 0, True
    for i, c in enumerate(body):
        escaped = i > 0 and body[i - 1] == "\\"
        if start and not (grouped and i == 0):
            if body[i : i + 2] == r"\d":
                found.append(r"\d")
            elif c.isascii() and c.isalnum() or c == "%":
                if body[i + 1 : i + 2] in ("?", "*", "{"):
                    return ""
                found.append(c)
            else:
                return ""
            start = False
        if c in "()" and not escaped:
            depth += 1 if c == "(" else -1
        elif c == "|" and not escaped and depth == 0:
            return ""  # alternatives beside the boundary
        elif c == "|" and not escaped and grouped and depth == 1:
            start = True
        if grouped and depth == 0:
            break
    return f"(?=[{''.join(sorted(set(found)))}])" if body[:1] not in ("", "[") and found and not (grouped and body[i + 1 : i + 2] in ("?", "*", "|")) else ""


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with its boundaries and white space spelled out; where a boundary stands next to a word, one look-around will do."""
    words_only = "%" not in pattern
    ends_open = r"\.?|" in pattern or pattern.endswith(r"\.?)\b")
    out, inside, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and words_only and (i == 0 or (pattern[i - 1] == "|" and i + 2 < len(pattern))):
            out.append(f"(?<!{_WORD})")
        elif pair == r"\b" and words_only and not ends_open:
            out.append(f"(?!{_WORD})")
        elif pair == r"\b":
            out.append(_EDGE)
        elif pair == r"\s":
            out.append(SPACES if inside else SPACE)
        elif pair[0] == "\\":
            out.append(pair)
        else:
            inside = pair[0] == "[" or (inside and pair[0] != "]")
            out.append(pair[0])
            i += 1
            continue
        i += 2
    ahead = _first(pattern) if pattern.startswith(r"\b") else ""
    return ("(?i)" if ignore_case else "") + ahead + "".join(out)


def either_case(pattern: str, ignore_case: bool = True) -> str:
    """The same for RE2, which Arrow looks for texts with: its boundaries are those of ASCII words, white space is spelled out, and ASCII letters, which the patterns have in no class, match in either case."""
    spaces = "".join(f"\\x{{{ord(c):x}}}" for c in SPACE_CHARS)
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append((spaces if inside else f"[{spaces}]") if pair == r"\s" else pair)
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if ignore_case and not inside and c.isascii() and c.isalpha() else c)
        i += 1
    return "".join(out)
