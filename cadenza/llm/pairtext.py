"""What one question and one answer say about each other, without a look at the rest of the corpus."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

#: What stands for no output, reduced to letters and digits.
PLACEHOLDERS = frozenset(
    "none null nil na nan empty blank nooutput noresponse noanswer notext nospeech silence silent inaudible missing undefined unknown "
    "notavailable notapplicable todo tbd 无 空 无输出 没有输出 无内容 无回答 无回复 无响应 静音 沉默 空白 keine leer vide aucune vacío ninguna".split()
)

#: Frequent function words by language, for Latin script.
FUNCTION_WORDS = {
    "en": frozenset("the a an is are was were be been it its this that these those there of to in on at by for with from and or but not no you your i me my we he she they them his her one has have had do does did so as if then than when while what which who how where will would can could should may up out about into over just now before after because".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden hat haben ich du er sie es wir ihr mit von zu zum zur auf aus bei nach für über unter im in am an noch nur auch jetzt dann gerade hinter neben weil dass davon seite bitte sehe jemand kein keine nein darf leider".split()),
    "fr": frozenset("le la les l un une des du de d et ou mais ne pas n est sont était a ont a je tu il elle on nous vous ils elles avec dans sur sous par pour en au aux ce cet cette ces qui que qu dont y maintenant encore puis car seulement derrière côté ensuite vient quelqu pour vois bougé peux".split()),
    "es": frozenset("el la los las un una unos unas de del y o pero no es son está están era ha han yo tú él ella con en sobre por para al lo que se su sus este esta ese esa ahora más solo muestra queda detrás junto porque después luego hay veo alguien acaba uno ellos puedo eso".split()),
    "it": frozenset("il lo la i gli le un uno una di del della dei delle e o ma non è sono era ha hanno io tu lui lei noi voi loro con su per da dal dalla al alla nel nella che si questo questa quello quella ora più solo dietro accanto perché dopo poi c qui sul sulla vedo posso".split()),
    "pt": frozenset("o a os as um uma uns umas do da dos das e ou mas não é são era foi tem eu tu ele ela nós vocês eles com em no na nos nas por para ao à que se seu sua este esta esse essa agora mais só atrás porque depois então há vejo está posso".split()),
    "nl": frozenset("de het een en of maar niet is zijn was wordt heeft hebben ik jij hij zij wij jullie met van naar op uit bij voor over onder in aan nog maar ook nu dan achter naast omdat dat dit deze die er geen kan zie mijn".split()),
}
#: Ranges of letters that tell a language or a family of languages by themselves.
SCRIPTS = {"ja": "\u3041-\u30ff\u31f0-\u31ff", "ko": "\u1100-\u11ff\uac00-\ud7af", "cyrl": "\u0400-\u052f", "grek": "\u0370-\u03ff", "arab": "\u0600-\u06ff\u0750-\u077f", "hebr": "\u0590-\u05ff", "thai": "\u0e00-\u0e7f", "deva": "\u0900-\u097f"}
#: Languages by number: none that can be told, Chinese, the scripts, the Latin ones, Latin without more.
LANGUAGES = (None, "zh", *SCRIPTS, *FUNCTION_WORDS, "latin")
ENGLISH = list(FUNCTION_WORDS).index("en")

CJK = "㐀-鿿豈-﫿"
_CJK = re.compile(f"[{CJK}]")
_LATIN = re.compile(r"[a-zà-öø-ÿœß]+")
_WORDS = re.compile(f"[{CJK}]|[^\\W\\d_{CJK}]+")
_SCRIPTS = [re.compile(f"[{letters}]") for letters in SCRIPTS.values()]
_DROPPED = re.compile(r"[\W_]+")
_QUOTE = re.compile("[\"“«「『《‘]")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|『[^』]*』|《[^》]*》|‘[^’]*’")
#: A sentence ends at these, unless a digit follows as in 3.5.
_SENTENCE = re.compile(r"[.!?。!?…]+[\"”’)\]」』]*(?!\d)")
_ENDED = re.compile(r"[.!?。…~][\s\"”’)\]」』*_]*$")
_OPEN_END = re.compile(r"[,、;:(\[{/&+=\-–—][\s\"“]*$")
_ASKING = ("几", "什么", "哪", "多少", "吗", "怎么", "怎样", "谁", "为何", "是否")

#: Declining takes a word of inability or refusal and a word for what is declined. Fixed values.
_UNABLE = re.compile(
    r"\b(?:can ?not|can'?t|unable|not able|won'?t|will not|not allowed|not permitted|not comfortable|don'?t feel comfortable|do not feel comfortable|decline|refuse|outside|beyond|against|not in a position|not authori[sz]ed|not supposed|no way)\b"
    r"|\bne (?:peux|puis|pouvons|dois|souhaite|suis)\b|\bje refuse\b|\bno (?:puedo|podemos|debo|quiero|estoy|me)\b|\b(?:kann|darf|möchte|werde|dürfen|können)\b.{0,40}\b(?:nicht|kein\w*)\b|\bnon (?:posso|possiamo|voglio)\b|\bnão (?:posso|podemos|consigo|devo)\b"
    r"|无法|不能|没有办法|没办法|没法|不便|不方便|帮不了|帮不到|不可以|不允许|拒绝|恕|超出|不予|不会|不愿"
)
_DECLINED = re.compile(
    r"\b(?:help|assist|answer|answering|respond|reply|comment|provide|discuss|discussing|share|disclose|talk about|say|tell|fulfil+|comply|engage|continue with|support|what i can do|what i am able|my (?:abilities|capabilities|guidelines|scope)|that request|this request|such requests?|that information|this topic|do that|do this)\b"
    r"|\b(?:répondre|aider|discuter|fournir|partager|commenter|ayudar\w*|responder\w*|contestar\w*|comentar\w*|proporcionar\w*|compartir\w*|helfen|weiterhelfen|beantworten|antworten|kommentieren|aiutar\w*|risponder\w*|commentar\w*|fornir\w*|ajudar|fornecer)\b"
    r"|协助|帮助|帮你|帮您|帮不|帮到|回答|答复|回应|评论|提供|讨论|谈论|透露|分享|处理|满足|能力范围|我的能力|这个忙|这个请求|这类|相关信息"
)
#: Set phrases that decline by themselves. Fixed values.
_OUTRIGHT = re.compile(
    r"\b(?:must|have to|will|i'll|going to) pass on (?:this|that|it)\b|\b(?:against|violates?|contrary to) (?:my|our) (?:polic\w+|guidelines?|rules?|principles|programming)\b|\bwould rather not (?:say|answer|comment)\b|\bno comment\b"
    r"|没法说|不能说|不便说|不好说这|无可奉告|违反.{0,6}(?:规定|政策|准则)|\bdarf ich leider nicht\b|\bprefiero no (?:responder|contestar|decir)\b|\bsans commentaire\b"
)
#: Words and beginnings of words, one of which is in all that the three patterns match. Fixed values.
_DECLINE_WORDS = frozenset("can cannot can't cant not unable won't wont don't dont decline refuse outside beyond against no pass violates violate contrary rather ne non não nicht prefiero sans 无 没 不 帮 拒 恕 超 违".split())
_DECLINE_STARTS = ("kein",)
_FULL_STOPS = frozenset(".!?。…~")
LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))


def plain(text: str) -> str:
    """NFKC, with typographic quotes made straight."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'")
    return text


@lru_cache(maxsize=4096)  # the same question comes with the answer of every model
def reduced(text: str) -> str:
    return _DROPPED.sub("", text.casefold())


def is_empty(answer: str | None) -> bool:
    """NULL, nothing with a letter or digit, or only a placeholder for no output."""
    if not answer:
        return True
    r = reduced(plain(answer))
    return not r or r in PLACEHOLDERS


NO_COUNTS = (0,) * (2 + len(SCRIPTS) + len(FUNCTION_WORDS))


@lru_cache(maxsize=65536)
def word_counts(token: str) -> tuple[int, ...]:
    """What a token adds to the counts by which languages are told: Chinese characters, Latin words, words of
    each script, function words of each Latin language."""
    if _CJK.match(token):
        return (1, *NO_COUNTS[1:])
    latin = _LATIN.findall(token)
    if latin:
        return (0, len(latin), *NO_COUNTS[2 : 2 + len(SCRIPTS)], *(sum(w in words for w in latin) for words in FUNCTION_WORDS.values()))
    return (0, 0, *(int(bool(p.search(token))) for p in _SCRIPTS), *NO_COUNTS[2 + len(SCRIPTS) :])


@lru_cache(maxsize=4096)
def language(text: str) -> str | None:
    """One of LANGUAGES by script and function words; None where too little can be told.

    Quoted words do not count, nor does what few of them tell: a Latin text is said to be in a language
    only if that language's function words clearly lead.
    """
    bare = _QUOTED.sub(" ", text.lower()) if has_quotes(text) else text.lower()
    sums = [sum(c) for c in zip(*map(word_counts, _WORDS.findall(bare)), strict=True)]
    if not sums:
        return None
    cjk, words, scripts, latin = sums[0], sums[1], sums[2 : 2 + len(SCRIPTS)], sums[2 + len(SCRIPTS) :]
    most = max(scripts)
    if cjk == words == most == 0:
        return None
    if most and most >= words and 5 * most >= cjk:
        return list(SCRIPTS)[scripts.index(most)]
    if cjk * 0.6 >= words:
        return "zh" if cjk > 1 else None
    if words < 2:
        return None
    best, english = max(latin), latin[ENGLISH]
    leading = latin.index(best)
    if leading != ENGLISH and best >= 2 and best > 1.5 * english:
        return list(FUNCTION_WORDS)[leading]
    return "en" if english else "latin"


def other_language(question: str, answer: str) -> bool:
    """The answer as a whole is in another language than the question."""
    q, a = language(question), language(answer)
    if q is None or a is None or q == a:
        return False
    if "latin" in (q, a):  # Latin script, but which language is open: only the script can differ
        return "zh" in (q, a) and len(_LATIN.findall(answer.lower() if q == "zh" else question.lower())) >= 3
    return True


def _edits(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, or most + 1 if it is more: only the diagonals within ``most`` are filled."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    letters = Counter(a)
    letters.subtract(b)
    extra = sum(v for v in letters.values() if v > 0)
    if max(extra, extra - n + m) > most:  # that many letters have to go, or to come
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        diagonal, left, x = row[low - 1], i if low == 1 else far, a[i - 1]
        row[low - 1] = left
        least = left
        for j in range(low, high + 1):
            up = row[j] if j < i + most else far
            left = diagonal if x == b[j - 1] else 1 + (up if up < left else left) if (up if up < left else left) < diagonal else 1 + diagonal
            diagonal, row[j] = row[j], left
            if left < least:
                least = left
        if least > most:
            return far
    return min(row[m], far)


def _is_question_again(q: str, text: str, asking: list[str]) -> bool:
    """text is q with a slip of a few letters, and still asks what q asks."""
    if text == q:
        return True
    if abs(len(text) - len(q)) > max(2, len(q) // 6):
        return False
    return all(w in text for w in asking) and _edits(q, text, max(2, len(q) // 8)) <= max(2, len(q) // 8)


def begins_again(question: str, answer: str) -> bool:
    """Whether the answer has the beginning of the question somewhere: short of an altered question by itself
    or a doubled one, no copy lacks it."""
    return reduced(question)[:6] in reduced(answer)


def question_copy(question: str, answer: str) -> bool:
    """The answer says nothing but the question: altered a little, doubled, or introduced."""
    q, a = reduced(question), reduced(answer)
    if len(q) < 4 or len(a) < 0.75 * len(q):
        return False
    asking = [w for w in _ASKING if w in q]
    if _is_question_again(q, a, asking):
        return True
    has_cjk = bool(_CJK.search(q))
    intro = 10 if has_cjk else 30
    if q in a:
        # Whatever remains must be an introduction in front, or pieces of the question itself.
        head, *rest = a.split(q)
        rest = [x for x in rest if x and x not in q]
        if rest:
            return False
        return len(head) <= intro or head[-intro:] in q or any(head[:k] in q and len(head) - k <= intro for k in range(len(head), 3, -1))
    if len(a) <= len(q) + intro:  # introduced and altered
        for at in range(max(1, len(a) - len(q) - 2), min(len(a), len(a) - len(q) + 3)):
            if a[at : at + 6] == q[:6] and _is_question_again(q, a[at:], asking):
                return True
    if abs(len(a) - 2 * len(q)) <= 2 * max(2, len(q) // 6):  # doubled and altered
        for at in range(len(a) // 2 - 3, len(a) // 2 + 4):
            if _is_question_again(q, a[:at], asking) and _is_question_again(q, a[at:], asking):
                return True
    return False


def declines(clause: str) -> bool:
    """The clause has a word of inability or refusal and one for what is declined, or a set phrase for both."""
    return bool(_UNABLE.search(clause) and _DECLINED.search(clause) or _OUTRIGHT.search(clause))


def may_decline(token: str) -> bool:
    """Whether a token can be part of what ``declines`` looks for: without such a token nothing declines."""
    return token in _DECLINE_WORDS or token.startswith(_DECLINE_STARTS)


def surely_ended(answer: str) -> bool:
    return answer[-1:] in _FULL_STOPS


def ending(answer: str) -> str:
    """How the text ends: ``ended`` (a full stop or the like), ``open`` (in a comma, an open bracket or the
    like) or ``bare``."""
    text = answer.rstrip(" \t\r\n\u200b\ufeff*_")
    if _ENDED.search(text):
        return "ended"
    last = _SENTENCE.split(text)[-1]
    if _OPEN_END.search(text) or last.count("(") > last.count(")") or last.count('"') % 2:
        return "open"
    return "bare"


def has_quotes(text: str) -> bool:
    return _QUOTE.search(text) is not None
