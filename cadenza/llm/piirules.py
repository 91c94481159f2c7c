"""Where personal information stands in a free text: rules on forms, check digits and contexts.

All rules read one normalized copy of the text in which every character keeps its place: full-width
forms become plain ones and all kinds of space one space. What one finds is claimed in the order
email, identity number, phone, address, name; a later find that overlaps an earlier one is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Item = tuple[str, int, int]  # type, start, end

_PLAIN = {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys([0x3000, 0xA0, 0x2007, 0x202F, 0x2009], " ") | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013], "-")


_NOT_PLAIN = re.compile("[\uff01-\uff5e\u3000\xa0\u2007\u202f\u2009\u2010-\u2013]")


def normalized(text: str) -> str:
    return text if text.isascii() else _NOT_PLAIN.sub(lambda m: _PLAIN[ord(m[0])], text)


# --- email -----------------------------------------------------------------------------------------
_AT = r"(?:\s?@\s?|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|艾特)"
_DOT = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?)({_AT})((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,24}})(?![A-Za-z0-9-])".lower())
_WORD_AT = re.compile(r"\s+at\s+", re.I)


def emails(low: str) -> Iterator[Item]:
    at = 0
    while m := _EMAIL.search(low, at):
        # "name at place.com" is ordinary prose unless the dots are spelled out as well; what comes after the
        # word may be the address itself.
        if _WORD_AT.fullmatch(m[2]) and "." in m[3]:
            at = m.end(2)
            continue
        yield "email", m.start(), m.end()
        at = m.end()


def lowered(t: str) -> str:
    """In lower case, every character in its place. Patterns on it need no flag for case, under which the
    engine can't skip to where a match may begin."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


_CLUSTER = re.compile(r"\d[\d ().+/-]{4,}\d")


def number_windows(t: str) -> list[tuple[int, int]]:
    """Stretches around six digits and more with nothing but the marks of numbers between them: all that
    the patterns of numbers have to read."""
    out: list[tuple[int, int]] = []
    for m in _CLUSTER.finditer(t):
        if sum(map(str.isdigit, m[0])) >= 6:
            start, end = max(0, m.start() - 6), min(len(t), m.end() + 6)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


# --- numbers ---------------------------------------------------------------------------------------
#: Words in front of a number that make it something other than a person's.
_NOT_PERSONAL = re.compile(
    r"(?:ticket|batch|lot|lote|charge|order|part|session|barcode|build|serial|sku|rows?|release|version|versión|invoice|tracking|offset|model|item|unit|frame|slot|ref|case|n°|no\.?|批次|批次编号|订单|订单号|会话|工单|工单号|条码|版本|序列号|单号|编号|缓冲区|采样率)"
    r"[\s:#№°.号]*(?:n[o°º]\.?|number|nr\.?|is|编号|号|为|是)?[\s:#_]*$",
    re.I,
)
_PASSPORT_NO = re.compile(r"(?:passport|passeport|pasaporte|reisepass|ausweis|护照|id|identity|card|insurance|security|tax|dni|nie|ssn)\W*(?:no\.?|n°|nº|nr\.?|number)\W*$", re.I)
_START, _END = r"(?<![A-Za-z0-9_./#@+-])(?<!\d,)(?<!\d )", r"(?![A-Za-z0-9_]|[.,:/-]\d)"
_SSN = re.compile(rf"{_START}\d{{3}}([-. ])\d{{2}}\1\d{{4}}{_END}")
_NINE = re.compile(rf"{_START}\d{{9}}{_END}")
_NINO = re.compile(rf"{_START}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D](?![A-Za-z0-9])", re.I)
_PASSPORT = re.compile(rf"{_START}[A-Z]{{2}} ?\d{{7}}{_END}", re.I)
_ANY_PASSPORT = re.compile(r"(?:passport|passeport|pasaporte|reisepass|ausweis|护照)\w*[\s:.]*(?:n[o°ºr]?\.?|number|号码?|是|为|:)?[\s:.]*([A-Z]{0,2} ?\d{6,9}[A-Z]?)(?![A-Za-z0-9])", re.I)
_CHINA = re.compile(r"(?<![A-Za-z0-9_.-])(\d{6}) ?((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]) ?(\d{3})([\dXx])(?![A-Za-z0-9])")
_CPF = re.compile(rf"{_START}\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{_END}")
_ID_CARD = re.compile(r"\b(?:id|identity) (?:card|number|no\.?)[\s:#]*(?:is )?(\d{6,14})(?![A-Za-z0-9])", re.I)
_DNI = re.compile(rf"{_START}([XYZ]?\d{{7,8}})[- ]?([A-Z]){_END}", re.I)
_STEUER = re.compile(rf"{_START}\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{3}}{_END}")
_SECU = re.compile(rf"{_START}\d ?\d{{2}} ?\d{{2}} ?\d{{2}} ?\d{{3}} ?\d{{3}}(?: ?\d{{2}})?{_END}")
#: Words about identity numbers, within reach of a bare number.
_IDENTITY_WORD = re.compile(r"\b(?:ssn|ni|nino|social security|identity|identification|id|tax|tin|says number|says|card|national insurance|driver'?s? licen[cs]e)\b|身份|证|填|卡片", re.I)
_STEUER_WORD = re.compile(r"steuer|ident|idnr|tin\b", re.I)
_SECU_WORD = re.compile(r"sécu|secu|insee|nir\b|social", re.I)
_DNI_WORD = re.compile(r"\b(?:dni|nie|nif)\b", re.I)
_CHINA_WEIGHTS, _CHINA_CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def china_check(first17: str) -> str:
    return _CHINA_CHECKS[sum(int(a) * b for a, b in zip(first17, _CHINA_WEIGHTS, strict=True)) % 11]


def dni_letter(number: str) -> str:
    n = number.upper()
    return _DNI_LETTERS[int({"X": "0", "Y": "1", "Z": "2"}.get(n[0], n[0]) + n[1:]) % 23]


def cpf_checks(first9: str) -> str:
    """The two check digits of a Brazilian tax number."""
    digits = [int(c) for c in first9]
    for _ in range(2):
        rest = sum(d * w for d, w in zip(digits, range(len(digits) + 1, 1, -1), strict=True)) * 10 % 11
        digits.append(rest % 10)
    return "".join(map(str, digits[9:]))


def steuer_check(first10: str) -> str:
    """The check digit of a German tax number (ISO 7064, modulo 11, 10)."""
    product = 10
    for c in first10:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return str((11 - product) % 10)


def _spared(t: str, at: int) -> bool:
    """A word in front says that the number is a ticket, a batch or the like."""
    before = t[max(0, at - 24) : at]
    return bool(_NOT_PERSONAL.search(before)) and not _PASSPORT_NO.search(before)


def within(p: re.Pattern, t: str, windows: list[tuple[int, int]]) -> Iterator[re.Match]:
    for start, end in windows:
        yield from p.finditer(t, start, end)


def identity_numbers(t: str, windows: list[tuple[int, int]]) -> Iterator[Item]:
    kind = "identity_number"
    for m in within(_CHINA, t, windows):
        if china_check(m[1] + m[2] + m[3] + m[4] + m[5]) == m[6].upper() and not _spared(t, m.start()):
            yield kind, m.start(), m.end()
    for m in within(_SSN, t, windows):
        if not _spared(t, m.start()):
            yield kind, m.start(), m.end()
    for m in within(_NINO, t, windows):
        if m[0][:2].isupper() or _IDENTITY_WORD.search(t[max(0, m.start() - 40) : m.start()]):
            yield kind, m.start(), m.end()
    for m in within(_PASSPORT, t, windows):
        if m[0][:2].isupper() and not _spared(t, m.start()):
            yield kind, m.start(), m.end()
    for m in _ANY_PASSPORT.finditer(t):
        yield kind, m.start(1), m.end(1)
    for m in _ID_CARD.finditer(t):
        yield kind, m.start(1), m.end(1)
    for m in within(_CPF, t, windows):
        digits = re.sub(r"\D", "", m[0])
        if cpf_checks(digits[:9]) == digits[9:]:
            yield kind, m.start(), m.end()
    for m in within(_DNI, t, windows):
        if dni_letter(m[1]) == m[2].upper() and (_DNI_WORD.search(t[max(0, m.start() - 16) : m.start()]) or m[2].isupper() and len(m[1]) == 8 and not _spared(t, m.start())):
            yield kind, m.start(), m.end()
    for m in within(_STEUER, t, windows):
        if _STEUER_WORD.search(t[max(0, m.start() - 40) : m.start()]):
            yield kind, m.start(), m.end()
    for m in within(_SECU, t, windows):
        if _SECU_WORD.search(t[max(0, m.start() - 40) : m.start()]):
            yield kind, m.start(), m.end()
    for m in within(_NINE, t, windows):
        near = t[max(0, m.start() - 48) : m.start()].rsplit("\n", 1)[-1] + t[m.end() : m.end() + 28].split("\n", 1)[0]
        if not _spared(t, m.start()) and _IDENTITY_WORD.search(near):
            yield kind, m.start(), m.end()


_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
_PHONES = [
    # North America, with or without the country and the area
    re.compile(rf"(?:(?<![A-Za-z0-9_.,/#@-])\+?|\+)1[ .-]?\(?[2-9]\d{{2}}\)?[ .-]?[2-9]\d{{2}}[ .-]?\d{{4}}{_END}"),
    re.compile(rf"{_START}(?:\([2-9]\d{{2}}\) ?|[2-9]\d{{2}}[ .-])[2-9]\d{{2}}[ .-]\d{{4}}{_END}"),
    re.compile(rf"{_START}[2-9]\d{{2}}-\d{{4}}{_END}"),
    # Any country with its code
    re.compile(rf"(?<![A-Za-z0-9_])(?:\(\+\d{{1,3}}\)|\+\d{{1,3}})[ .-]?(?:\(0?\d{{0,4}}\)[ .-]?)?\d(?:[ .-]?\d){{5,12}}{_END}"),
    re.compile(rf"{_START}00(?:86|1|44|49|33|34|39|81|82)[ -]?(?:\(0?\d{{0,4}}\)[ -]?)?\d(?:[ -]?\d){{5,12}}{_END}"),
    # China: mobile and landline
    re.compile(rf"{_START}1[3-9]\d[ -]?\d{{4}}[ -]?\d{{4}}{_END}"),
    re.compile(rf"{_START}(?:\(0\d{{2,3}}\) ?|0\d{{2,3}}-)\d{{7,8}}{_END}"),
    # The Netherlands, Britain, Germany, France, Spain, as dialled at home
    re.compile(rf"{_START}06[ -]\d{{8}}{_END}"),
    re.compile(rf"{_START}(?:0[27]\d(?: ?\d{{4}} ?\d{{4}})|07\d{{3}} ?\d{{3}} ?\d{{3}}|0\d{{3,4}} \d{{3}} ?\d{{3,4}}){_END}"),
    re.compile(rf"{_START}(?:\(0\d{{2,4}}\) ?|0\d{{2,4}}[ /-])\d{{3,8}}(?:[ -]\d{{2,4}})?{_END}"),
    re.compile(rf"{_START}0[1-9](?:([ .-])\d{{2}})(?:\1\d{{2}}){{3}}{_END}"),
    re.compile(rf"{_START}[6789]\d{{2}}([ -])\d{{3}}\1\d{{3}}{_END}"),
]
#: Forms that are a phone number only if something near says so.
_BARE = re.compile(rf"{_START}(?:[2-9]\d{{2}}[ .]\d{{4}}|[2-9]\d{{9}}|[6789]\d{{8}}|0\d{{9,10}}){_END}")
_PHONE_WORD = re.compile(r"\b(?:call|text|phone|tel|tél|mobile|cell|fax|whatsapp|ring|dial|number|reach|llame|llámame|teléfono|móvil|appelez|numéro|nummer|anrufen|handy|rückfragen)\b|电话|手机|致电|拨打|请打|号码|\bal $|\bau $", re.I)
_SPOKEN = re.compile(rf"(?<![a-z])(?:{_DIGIT_WORD}[ ,-]+){{6,14}}{_DIGIT_WORD}(?![a-z])")
_SPOKEN_WORDS = tuple(_DIGIT_WORD[3:-1].split("|"))
_SPOKEN_ZH = re.compile(r"[零〇一二三四五六七八九幺]{7,12}")


def phones(t: str, low: str, windows: list[tuple[int, int]], spoken: bool) -> Iterator[Item]:
    for p in _PHONES:
        for m in within(p, t, windows):
            if not _spared(t, m.start()):
                yield "phone", m.start(), m.end()
    for m in within(_BARE, t, windows):
        if _PHONE_WORD.search(t[max(0, m.start() - 28) : m.start()].rsplit("\n", 1)[-1]) and not _spared(t, m.start()):
            yield "phone", m.start(), m.end()
    if spoken:
        for m in _SPOKEN.finditer(low):
            yield "phone", m.start(), m.end()
    if not t.isascii():
        for m in _SPOKEN_ZH.finditer(t):
            yield "phone", m.start(), m.end()


# --- street addresses ------------------------------------------------------------------------------
_EN_KIND = r"(?:street|st|road|rd|lane|ln|court|ct|close|avenue|ave|row|hill|drive|dr|place|pl|square|sq|terrace|crescent|gardens|grove|mews|boulevard|blvd|parade|walk|quay|alley|way)"
#: From the number on; what stands before and after it is added by the two below.
_EN = re.compile(rf"\d(?<![a-z0-9_.:#/-]\d)\d{{0,3}}[a-z]? (?:[a-z][a-z'’-]+ ){{1,2}}{_EN_KIND}\b\.?")
_EN_FLAT = re.compile(r"(?<![a-z0-9])(?:flat|apt|apartment|unit|suite|room)\.? \d+[a-z]?,? $")
_EN_REST = re.compile(r"(?:,? (?:[Ff]lat|FLAT|[Aa]pt|APT|[Aa]partment|[Uu]nit|[Ss]uite)\.? \d+[A-Za-z]?\b)?(?:, [A-Z][A-Za-z'’-]+(?: [A-Z][A-Za-z'’-]+)?)?(?:,? \d{5}(?! ?\d))?")
#: Words that stand between a count and a thing, not in the name of a street.
_NO_STREET = re.compile(r"\b(?:of|and|the|for|to|in|on|at|from|with|is|are|was|were|minutes?|seconds?|times?|more|left|right|rows?|new|same|each|per|by|or|then|which|that)\b", re.I)
_DE = re.compile(
    r"(?<![\wäöüÄÖÜß])(?:[A-ZÄÖÜ][\wäöüÄÖÜß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|hof|steig|STRASSE|STRAẞE|STRAßE|STR\.|WEG|GASSE|PLATZ|ALLEE)"
    r"|[a-zäöü][\wäöüß-]{2,}(?:straße|strasse|str\.|weg|gasse|platz|allee)"
    r"|(?:(?:Alte|Alter|Altes|Neue|Neuer|Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Lange|Langer|Kleine|Kleiner|Große|Großer|Hohe|Hoher|Untere|Obere|Unter den|ALTE|NEUE|AM|IM|ZUM|ZUR|LANGE|alte|neue|lange|am|im|zum|zur) )+[A-ZÄÖÜa-zäöü][\wäöüÄÖÜß-]+(?: [A-ZÄÖÜ][\wäöüß-]+)?)"
    r" \d{1,4}(?: ?[a-zA-Z])?(?![\wäöü])(?:, \d{5} [A-ZÄÖÜ][\wäöüß-]+)?"
)
_FR = re.compile(
    r"\d(?<![\w.:#/-]\d)\d{0,3}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|quai|impasse|boulevard|bd|place|chemin|allée|route|cours|square|passage|sentier|ruelle|faubourg|villa) "
    r"(?:(?:de la |de l['’]|de |du |des |d['’]|la |le |les |l['’])*[\wÀ-ÿ'’-]+(?:[ -](?:de |du |des |d['’])?[A-ZÀ-Þ][\wÀ-ÿ'’-]*)*)(?:, (?:(?:appt|apt|bât)\.? \w+, )?\d{5} [A-ZÀ-Þ][\wÀ-ÿ'’-]+)?",
    re.I,
)
_ES_KIND = r"(?:Avenida|Avda\.?|Av\.|Calle|C/|Paseo|Plaza|Pza\.?|Camino|Carretera|Ronda|Travesía|Callejón|Cuesta|Glorieta|Rambla)"
_ES = re.compile(rf"(?<!\w){_ES_KIND} ?(?:(?:de|del|la|las|los|el|y) )*[A-ZÁÉÍÓÚÑ][\wáéíóúñÁÉÍÓÚÑ]+(?: (?:(?:de|del|la|las|los|el|y) )*[A-ZÁÉÍÓÚÑ][\wáéíóúñÁÉÍÓÚÑ]+)*,? (?:n\.? ?º ?|nº ?|núm\.? ?)?\d{{1,4}}(?!\d)(?:, \d+\.?[ºª]\.?(?: [A-Z](?!\w))?)?(?:, \d{{5}} [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?")
_ES_ANY_CASE = re.compile(r"(?<!\w)(?:avenida|calle|c/|paseo|plaza|camino|ronda) ?(?:(?:de|del) (?:(?:la|las|los|el) )?)?[a-záéíóúñ]+(?: [a-záéíóúñ]+){0,2},? (?:n\.? ?º ?|nº ?|núm\.? ?)?\d{1,4}(?!\d)(?:, \d{5} [A-ZÁÉÍÓÚÑ]\w+)?", re.I)
_IT = re.compile(r"(?<!\w)(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada) (?:(?:del|della|dei|delle|degli|di|da|dell['’]) ?)?[A-ZÀ-Ý][\wà-ÿ'’]+(?: [A-ZÀ-Ý][\wà-ÿ'’]+)*,? (?:n\.? ?)?\d{1,4}(?:/?[a-zA-Z])?(?![\w.])(?:, (?:\d{5} )?[A-ZÀ-Ý][\wà-ÿ]+)?")
_IT_WORDS = ("via ", "viale ", "piazza", "corso ", "largo ", "vicolo ", "strada ")
_ES_MUST = re.compile(r"(?:avenida|calle|c/|paseo|plaza|camino|ronda) ?(?:de|del) |calle |c/", re.I)
#: Chinese characters that lead up to an address rather than begin its name.
_LEAD = "从到在住寄送往至了去于是写我们他她你的让把和与家址给向就号请"
_ZH_NAME = f"[^\\W\\dA-Za-z_{_LEAD}市区县]"
_ZH = re.compile(
    rf"(?:{_ZH_NAME}{{2,5}}省)?(?:{_ZH_NAME}{{2,3}}市)?(?:{_ZH_NAME}{{2,3}}[区县])?{_ZH_NAME}{{1,4}}?(?:大道|路|街|巷|道|弄|胡同)\d{{1,4}}(?:-\d+)?号"
    r"(?:院内|院)?(?:\d+(?:栋|幢|座|号楼|楼|单元|室)?)*(?:\d+(?:室|房)?)?"
)


#: What a text must hold for the pattern of a language to be tried.
_DE_WORDS = ("straße", "strasse", "straẞe", "str.", "weg ", "gasse ", "platz ", "allee ", "ufer ", "ring ", "damm ", "hof ", "steig ", "am ", "an de", "im ", "zum ", "zur ", "auf de", "unter den", "alte", "neue", "lange", "kleine", "große", "hohe", "obere", "in der")
_FR_WORDS = ("rue ", "avenue ", "av. ", "quai ", "impasse ", "boulevard ", "bd ", "place ", "chemin ", "allée ", "route ", "cours ", "square ", "passage ", "sentier ", "ruelle ", "faubourg ", "villa ")
_ES_WORDS = ("avenida", "avda", "av.", "calle", "c/", "paseo", "plaza", "pza", "camino", "carretera", "ronda", "travesía", "callejón", "cuesta", "glorieta", "rambla")


def addresses(t: str, low: str, gate: int) -> Iterator[Item]:
    kind = "street_address"
    if "号" in t:
        for m in _ZH.finditer(t):
            yield kind, m.start(), m.end()
    for m in _EN.finditer(low):
        street = re.sub(rf"^\d+[a-z]? |\b{_EN_KIND}\b.*$", "", m[0])
        if not _NO_STREET.search(street):
            flat = _EN_FLAT.search(low[max(0, m.start() - 18) : m.start()])
            yield kind, m.start() - (len(flat[0]) if flat else 0), _EN_REST.match(t, m.end()).end()
    if gate & GATE["it"]:
        for m in _IT.finditer(t):
            yield kind, m.start(), m.end()
    if gate & GATE["de"]:
        for m in _DE.finditer(t):
            yield kind, m.start(), m.end()
    if gate & GATE["fr"]:
        for m in _FR.finditer(t):
            yield kind, m.start(), m.end()
    if gate & GATE["es"]:
        for m in _ES.finditer(t):
            yield kind, m.start(), m.end()
        for m in _ES_ANY_CASE.finditer(t):
            if _ES_MUST.match(m[0]):
                yield kind, m.start(), m.end()


# --- names of persons ------------------------------------------------------------------------------
_U = r"A-ZÀ-ÖØ-Þ"
_L = r"a-zß-öø-ÿ"
_TOKEN = rf"(?:[{_U}][{_L}{_U}'’]+(?:-[{_U}][{_L}{_U}'’]+)*)"
_INITIAL = rf"(?:[{_U}]\.)"
_PART = rf"(?:{_TOKEN}|{_INITIAL})"
#: Given and family name, initials among them; or family name, comma, given name.
_FULL = rf"(?:{_PART}(?: {_PART}){{0,2}} {_TOKEN}|{_TOKEN}, {_TOKEN}(?: {_INITIAL})?|{_TOKEN}, {_INITIAL}(?: ?{_INITIAL})?)"
#: The same where case was lost; only between two firm contexts.
_LOWER = rf"(?:(?:[{_L}]\.|[{_L}][{_L}'’-]+)(?: [{_L}]\.)? [{_L}][{_L}'’-]{{2,}}|[{_L}][{_L}'’-]{{2,}}, (?:[{_L}]\.|[{_L}][{_L}'’-]+))"
_ANY = rf"(?:{_FULL}|{_LOWER})"
_STOP = re.compile(r"(?i)^(?:the|a|an|my|our|your|his|her|its|this|that|these|those|it|he|she|we|they|you|i|and|or|but|if|when|what|which|where|how|who|at|in|on|to|from|by|for|flat|apt|unit|now|then|next|please|start|go|keep|tell|let|watch|put|both|somebody|someone|nobody|everybody|der|die|das|den|dem|ein|eine|im|am|bitte|le|la|les|un|une|il|elle|el|los|las|en|tel|passport|user|assistant|street|road|each|all|any|no|not|one|two|is|was|are|puis|luego|danach|dann|después|entonces|gracias|merci|gruß|thanks|hello|hi|dear|contact|annotator|reviewer|recorded|prof|dr|mr|mrs|ms|frau|herr|herrn|mme|señora|señor|after|before|again|overall|counting|loved|score)$")
#: (context before, context after, whether case may be lost). Phrases that announce a person.
_CONTEXTS = [
    (r"(?:Reviewed-by|Contact|Author|Signed-off-by|Annotated-by|Recorded-by|Reviewer|Annotator|Speaker|Name|Customer|Patient|Recipient|Assignee|Owner|From|Attn)\s*: ?", r"", True),
    (r"\b(?:belongs to|goes to|Recorded by|Annotated by|Reviewed by|Written by|Signed by|reads|card on the table says|can reach|this is|my name is|I am called|the driver,|[Cc]onsent signed:|signed:|there when|I think|Annotator|annotator|and reviewer|reviewer|Then|then|ask for|call for|Dear|Hello|Hi)\s+", None, True),
    (r"\b(?:Laut Ausweis .{5,14} ist das|Danach kam|Dann kam|Rückfragen an|geht an|Aufgenommen von|Annotiert von|Geprüft von|[Ii]ch heiße|[Mm]ein Name ist|Hier ist|hier spricht)\s+", None, True),
    (r"\b(?:part chez|Annoté par|Enregistré par|Relu par|Puis|Appelez|[Jj]e m['’]appelle|[Ii]ci|[Cc]'est|Bonjour)\s+", None, True),
    (r"\b(?:Llame a|va a|Anotado por|Grabado por|Revisado por|[Mm]e llamo|[Ss]oy|Luego|Después|Entonces|Hola,|Luego entró|Después entró|Según (?:el|la) (?:DNI|pasaporte) .{5,14} es)\s+", None, True),
]
#: A name that closes a message, whatever comes after it. Fixed values.
_CLOSING = re.compile(
    rf"(?:(?:^|[\s(])[—–-]{{1,2}} ?|\b(?:Thanks|Thank you|Cheers|Regards|Sincerely|Best|Yours|Gruß|Grüße|MfG|Danke|Merci|Cordialement|Gracias|Saludos|Atentamente),?\s+|\b(?P<field>owner|user|name|assignee|reviewer|annotator|author)\s?= ?)"
    rf"(?P<name>{_PART}(?: {_INITIAL})? {_TOKEN}|{_TOKEN}, {_TOKEN}|(?(field){_LOWER}|{_LOWER}(?=\s*(?:$|[.,;!\n]))))",
    re.M,
)
_CLOSING_WORDS = ("— ", "– ", "--", "- ", "Thank", "Cheers", "Regards", "Sincerely", "Best", "Yours", "Gruß", "Grüße", "MfG", "Danke", "Merci", "Cordialement", "Gracias", "Saludos", "Atentamente", "=")
_COUPLED = re.compile(rf" (?:and|und|et|y) (?P<name>{_ANY})(?= (?:watched|disagree|said|lives|came|walked|will|were|are|both))")
#: One of these stands in every text that _COUPLED can match.
_COUPLED_WORDS = (" and ", " und ", " et ", " y ")
#: What may follow a name that only the words before it announce, so that a sentence is not one.
_AFTER = re.compile(
    r"^(?:\s*[,;:.!?()<\[\]\n—]|\s*$|\s+(?:and|at|on|put|will|can|said|says|came|walked|walks|lives|wrote|has|had|is|was|disagree|watched|<|\(|\d|\+"
    r"|herein|wohnt|und|kam|hat|ist|Tel|est|et|habite|au|a|al|y|vive|entró|ha|dijo|llamó|[A-Z]{2} ?\d))"
)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern's first group."""
    out, depth, start = [], 0, pattern.index("(?:") + 3
    for i in range(start, len(pattern)):
        c = pattern[i]
        if depth == 0 and c in "|)":
            out.append(pattern[start:i])
            start = i + 1
            if c == ")":
                break
        depth += (c == "(") - (c == ")")
    return out


def _longest_literal(pattern: str) -> str:
    """The longest stretch of a pattern that stands for itself."""
    return max(re.split(r"\\[bs]|\(\?:[^)]*\)|\[[^]]*\]|\.\{.*?\}|[()?*+]", pattern), key=len).strip()


#: A word of each phrase that announces: one of them must be in a text for its pattern.
_LEADS = [tuple(dict.fromkeys(map(_longest_literal, _alternatives(lead)))) for lead, _, _ in _CONTEXTS]
_BEFORE_CONTEXTS = [(re.compile(rf"(?P<lead>{lead})(?P<name>{_ANY if lost else _FULL})(?P<after>{after or ''})", re.M), after is None) for lead, after, lost in _CONTEXTS]
_VERBS = r"(?:lives at|said the|said that|said|came home|walked in|watched the|will ring|can be reached|wrote|wohnt|habite|vive en|est entré|entró|kam herein|put it|joined|left the room|disagree)"
_VERB_WORDS = (*_VERBS[3:-1].split("|"), "said", "lives", "came", "walked", "are both")
_VERB_AFTER = re.compile(rf"(?:(?<=^)|(?<=[.!?:,\n] )|(?<=\s))(?P<name>{_FULL})(?= (?:and {_FULL} )?{_VERBS})", re.M)
_VERB_LOWER = re.compile(rf"(?:^|(?<=[.!?:]\s)|(?<=user: )|(?<=assistant: ))(?P<name>{_LOWER})(?= {_VERBS})", re.M)
_ADDRESSED = re.compile(rf"(?P<name>{_FULL})(?=\s*(?:<|\(|，)\s*$|,? ?$)")
_TITLE = re.compile(
    rf"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Sir|Madam|Herrn?|Frau|Fräulein|Mme|Mlle|Madame|Monsieur|[Ss]eñora?|[Ss]eñorita|Sra?|Srta|Dña|Don|Doña|MR|MRS|MS|DR|PROF|HERR|FRAU|MME)\.? "
    rf"(?P<name>(?:{_PART} ){{0,2}}{_TOKEN}|[{_L}][{_L}'’-]{{2,}}(?= (?:lives|wohnt|habite|vive)))"
)
#: "M." is a title in French and an initial elsewhere.
_MONSIEUR = re.compile(rf"\bM\. (?P<name>(?:{_PART} )?{_TOKEN})(?= (?:habite|est|a|et|au|vit|demande)\b)")
_GENDERED = re.compile(rf"\b(?:[Ll]a señora|[Ee]l señor|[Ff]rau|[Hh]err|[Mm]me|[Mm]r\.?|[Mm]rs\.?|[Mm]s\.?|[Dd]r\.?|[Pp]rof\.?) (?P<name>{_LOWER}|[{_L}][{_L}'’-]{{2,}})(?= (?:lives|wohnt|habite|vive|said|will|came|walked|asked))")
#: Chinese contexts, and family names of two characters.
_ZH_DOUBLE = "欧阳|太史|端木|上官|司马|东方|独孤|南宫|万俟|闻人|夏侯|诸葛|尉迟|公羊|赫连|澹台|皇甫|宗政|濮阳|公冶|太叔|申屠|公孙|慕容|仲孙|钟离|长孙|宇文|司徒|鲜于|司空|闾丘|子车|亓官|司寇|巫马|公西|颛孙|壤驷|公良|漆雕|乐正|宰父|谷梁|拓跋|夹谷|轩辕|令狐|段干|百里|呼延|东郭|南门|羊舌|微生|公户|公玉|梁丘|左丘|东门|西门|单于"
_ZH_CHAR = r"[一-鿿]"
_ZH_PERSON = rf"(?:(?:{_ZH_DOUBLE}){_ZH_CHAR}{{1,2}}|{_ZH_CHAR}{{2,3}}|{_ZH_CHAR}·{_ZH_CHAR}{{2,4}})"
_ZH_NAMES = [
    re.compile(rf"(?:联系人|收件人|寄件人|姓名|签收人|复核人|标注人|经办人|负责人|记录人|(?:复核|标注|录音|录制|审核|署名|签名)(?=:))\s*[:是为]?\s*(?P<name>{_ZH_PERSON})(?=[\s,，。;；:：()（）、<\n]|$|和|与|电话|手机|在|于|的)"),
    re.compile(rf"(?:我叫|我是|名叫|叫做|谢谢，|谢谢,|谢谢|你好，|您好，|找|写着|请问是|标注员|复核员|录制人|记录员|快递员|司机)\s*(?P<name>{_ZH_PERSON})(?=[\s,，。;；:：()（）、<\n!！]|$|和|与|同意|意见|说|看|让|收|的|把|走|进|来|在|给|刚|会|先|先到)"),
    re.compile(rf"写\s*(?P<name>{_ZH_PERSON})(?=收)"),
    re.compile(rf"(?P<name>{_ZH_PERSON})(?=(?:老师|先生|女士|小姐|同学|师傅|医生|教授|阿姨|叔叔|经理)(?:[让说在来把要请的,，。和的给叫问]|$))"),
]


def _trimmed(name: str, start: int) -> tuple[int, int] | None:
    """Without words that only look like part of a name."""
    words = list(re.finditer(r"[^\s,]+", name))
    while words and (_STOP.match(words[0][0].rstrip(".,")) and len(words[0][0].rstrip(".")) > 1):
        words = words[1:]
    while words and _STOP.match(words[-1][0].rstrip(".,")) and len(words[-1][0].rstrip(".")) > 1:
        words = words[:-1]
    if len(words) < 2:
        return None
    return start + words[0].start(), start + words[-1].end()


#: A title in lower case and what follows it: without one there is no titled name.
_ANY_TITLE = re.compile(r"\b(?:mr|mrs|ms|miss|mx|dr|prof|professor|doctor|sir|madam|herrn?|frau|fräulein|mme|mlle|madame|monsieur|señora?|señorita|sra?|srta|dña|don|doña|m\.)\.? ")


def titled_names(t: str, low: str) -> Iterator[Item]:
    if not _ANY_TITLE.search(low):
        return
    for p in (_TITLE, _MONSIEUR, _GENDERED):
        for m in p.finditer(t):
            yield "person_name", m.start("name"), m.end("name")


def latin_names(t: str, gate: int) -> Iterator[Item]:
    kind = "person_name"
    for i, (p, needs_after) in enumerate(_BEFORE_CONTEXTS):
        for m in p.finditer(t) if gate & GATE[f"lead{i}"] else ():
            if needs_after and not _AFTER.match(t[m.end("name") :][:24]):
                continue
            if at := _trimmed(m["name"], m.start("name")):
                yield kind, *at
    for p, name in ((_VERB_AFTER, "verb"), (_VERB_LOWER, "verb"), (_CLOSING, "closing"), (_COUPLED, "coupled")):
        for m in p.finditer(t) if gate & GATE[name] else ():
            if at := _trimmed(m["name"], m.start("name")):
                yield kind, *at


_BEFORE_ITEM = re.compile(rf"(?P<name>{_ANY})(?:\s*<|\s*\(|,\s?|\s)$")


_SPEAKER = re.compile(r"^(?:\[[\d:]+\] )?(?:user: |assistant: |[QA]: )?")


def names_before(t: str, items: list[Item]) -> Iterator[Item]:
    """A name right in front of an item of a person: "Name <mail>", "Name, number", "Name, address"."""
    for kind, start, _ in items:
        line = t[max(0, start - 60) : start].rsplit("\n", 1)[-1]
        m = _BEFORE_ITEM.search(line)
        if kind == "person_name" or not m:
            continue
        joined = line.rstrip().endswith((",", "<", "("))
        if not joined and kind == "street_address":
            continue
        # Where case was lost, only a name that opens the line is told from other words.
        if m["name"][0].islower() and not (joined and m.start() == _SPEAKER.match(line).end()):
            continue
        if at := _trimmed(m["name"], start - len(line) + m.start("name")):
            yield "person_name", *at


_ZH_WORDS = (
    ("联系人", "件人", "姓名", "签收人", "复核", "标注", "经办人", "负责人", "记录人", "录音", "录制", "审核", "署名", "签名"),
    ("我叫", "我是", "名叫", "叫做", "谢谢", "你好", "您好", "找", "写着", "请问是", "标注员", "复核员", "录制人", "记录员", "快递员", "司机"),
    ("写",),
    ("老师", "先生", "女士", "小姐", "同学", "师傅", "医生", "教授", "阿姨", "叔叔", "经理"),
)


#: What follows a greeting or thanks and is nobody's name.
_ZH_SAID = frozenset("再见 拜拜 大家 各位 你们 我们 他们 老师 辛苦了 不客气 没事 好的 明白 知道了 配合 支持 合作 帮助".split())


def chinese_names(t: str, gate: int) -> Iterator[Item]:
    if t.isascii():
        return
    for i, p in enumerate(_ZH_NAMES):
        for m in p.finditer(t) if gate & GATE[f"zh{i}"] else ():
            if m["name"] not in _ZH_SAID:
                yield "person_name", m.start("name"), m.end("name")
    for m in re.finditer(rf"(?:^|[\n。！？!?\s:：])(?P<name>{_ZH_PERSON})(?=[,，] ?(?:\+|\(|0|1))", t):
        yield "person_name", m.start("name"), m.end("name")


# --- which patterns a text can match at all --------------------------------------------------------
_GATED = {
    "email": ("@", "艾特", "(at", "[at", "{at", "( at", "[ at"), "at": (" at ",), "dot": ("dot",), "de": _DE_WORDS, "fr": _FR_WORDS, "es": _ES_WORDS, "it": _IT_WORDS,
    "verb": _VERB_WORDS, "closing": _CLOSING_WORDS, "coupled": _COUPLED_WORDS,
    **{f"lead{i}": words for i, words in enumerate(_LEADS)}, **{f"zh{i}": words for i, words in enumerate(_ZH_WORDS)},
}
GATE = {name: 1 << i for i, name in enumerate(_GATED)}
_WORD_GATES: dict[str, tuple[int, int]] = {}
for _name, _words in _GATED.items():
    for _w in _words:
        _WORD_GATES[_w.lower()] = (_WORD_GATES.get(_w.lower(), (0, 0))[0] | GATE[_name], 0)
for _w in _SPOKEN_WORDS:
    _WORD_GATES[_w] = (_WORD_GATES.get(_w, (0, 0))[0], 1)


def _automaton() -> object | None:
    try:
        import ahocorasick
    except ImportError:
        return None
    made = ahocorasick.Automaton()
    for word, value in _WORD_GATES.items():
        made.add_word(word, value)
    made.make_automaton()
    return made


_AUTOMATON = _automaton()


def gates(low: str) -> tuple[int, bool]:
    """(the gates of all words in a text in lower case, whether it may hold a spoken number): one pass over it."""
    if _AUTOMATON is None:
        found = [v for w, v in _WORD_GATES.items() if w in low]
        return sum({1 << i for g, _ in found for i in range(len(GATE)) if g >> i & 1}), sum(low.count(w) for w in _SPOKEN_WORDS) >= 7
    gate, digits = 0, 0
    for _, (g, d) in _AUTOMATON.iter(low):
        gate |= g
        digits += d
    return gate, digits >= 7


# --- names told by what other texts call persons ---------------------------------------------------
#: The most frequent family names in Chinese.
FREQUENT_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_ZH_DOES = "说|进来|走进|来了|来过|打来|取走"
_ZH_CALLED = re.compile(
    rf"(?:(?:^|[\n\s:：。，,！!？?])(?P<bare>(?:{_ZH_DOUBLE}){_ZH_CHAR}{{1,2}}|{_ZH_CHAR}{{2,3}})(?={_ZH_DOES})"
    rf"|(?:刚才|请?联系|请找|交给|转交|通知|遇到)(?P<led>(?:{_ZH_DOUBLE}){_ZH_CHAR}{{1,2}}|{_ZH_CHAR}{{2,3}})(?={_ZH_DOES}|[,，。;；!！\s]|$))",
    re.M,
)
_RUN = re.compile(rf"(?<![\w.'’-]){_TOKEN}(?: {_INITIAL})*(?: {_TOKEN})(?: {_TOKEN})?(?![\w-])")
_SMALL = re.compile(rf"(?:^|[.!?:—–,\n] ?|(?:Thanks|Gruß|Merci|Gracias|Luego entró|Puis|Then), ?|(?:Luego entró|Puis|Then) )(?P<name>[{_L}][{_L}'’-]{{2,}}(?: [{_L}]\.)? [{_L}][{_L}'’-]{{2,}})(?=[,.;:!?\n]|$| [{_U}0-9]| (?:y|und|et|and) )", re.M)
_STOP_WORDS = frozenset(_STOP.pattern.removeprefix("(?i)^(?:").removesuffix(")$").split("|"))


def name_key(name: str) -> str | None:
    """What a name is known by: the given name of a Latin one, the family name of a Chinese one."""
    if re.match(_ZH_CHAR, name):
        return "z:" + (m[0] if (m := re.match(_ZH_DOUBLE, name)) else name[0])
    family, comma, given = name.partition(",")
    words = (given if comma else name).split()
    first = words[0].casefold().rstrip(".") if words and (comma or len(words) > 1) else ""
    return "g:" + first if len(first) > 2 else None


def may_be_names(text: str, items: list[Item]) -> list[tuple[str, int, int]]:
    """(key, start, end) of what could be the name of a person if other texts call persons so, apart from ``items``."""
    t = normalized(text)
    marks = bytearray(len(t))
    for _, start, end in items:
        marks[start:end] = b"\x01" * (end - start)
    out = []
    for p in (_RUN, _SMALL) if t.isascii() or re.search(f"[{_U}{_L}]", t) else ():
        for m in p.finditer(t):
            start, end = m.span("name") if p is _SMALL else m.span()
            if p is _SMALL and t[start : t.index(" ", start)] in _STOP_WORDS:
                continue
            if not any(marks[start:end]) and (key := name_key(t[start:end])) and (at := _trimmed(t[start:end], start)):
                out.append((key, *at))
    if not t.isascii():
        for m in _ZH_CALLED.finditer(t):
            start, end = m.span("bare" if m["bare"] else "led")
            if not any(marks[start:end]) and t[start] != t[start + 1]:
                out.append((name_key(t[start:end]), start, end))
    return out


def find(text: str) -> list[Item]:
    """All items of a text, in order of place, none of them overlapping."""
    t = normalized(text)
    taken: list[Item] = []
    marks = bytearray(len(t))

    def claim(found: Iterator[Item]) -> None:
        for item in sorted(found, key=lambda x: (x[1], -x[2])):
            if item[2] > item[1] and not any(marks[item[1] : item[2]]):
                marks[item[1] : item[2]] = b"\x01" * (item[2] - item[1])
                taken.append(item)

    low = lowered(t)
    gate, spoken = gates(low)
    windows = number_windows(t)
    if gate & GATE["email"] or gate & GATE["at"] and gate & GATE["dot"]:
        claim(emails(low))
    if windows:
        claim(identity_numbers(t, windows))
    claim(phones(t, low, windows, spoken))
    claim(addresses(t, low, gate))
    claim(titled_names(t, low))
    claim(latin_names(t, gate))
    claim(names_before(t, list(taken)))
    claim(chinese_names(t, gate))
    return sorted(taken, key=lambda x: x[1])
