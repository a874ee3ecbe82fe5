"""Problem 9: unfilled templates, filler text, error pages and script notices in place of content.

Records are aligned by template, in two ways. A slot is the place of a variable, default or blank among the words
around it; it is induced where other records have the same words with another filling or with none, or where lines
of one form vary there, and flagged where a record keeps a variable name, a default or a blank. A page or
stand-alone line or paragraph is a template if it repeats, numbers and codes masked, across records; it is flagged
if it has wording of a message, or, whatever its wording, if it is the whole of some records and stands in others.
Evidence that no other record shares ('lone') counts only where it is unmistakable: markup that only templates use,
program traces, messages that address the visitor. Text that mentions, quotes or explains such things is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .normalize import fold

#: Records that must share a template, and other records that must fill a slot otherwise.
MIN_SUPPORT = 3
#: Longest unit (page, paragraph, line) that can be a message, in characters and words; longest filling of a slot in words.
UNIT_CHARS, UNIT_WORDS, VALUE_WORDS = 400, 60, 4

# Shapes of an unfilled value. They name no word: a variable between marks, a bare identifier, a blank.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_ .:-]{1,2}[A-Za-z0-9]+){0,4}"
_SNAKE = r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+"
#: Marks that only templates use.
_SLOT = re.compile(
    rf"\{{\{{[\s#/^>&]*({_NAME})[^{{}}\n]{{0,30}}\}}\}}|[$#]\{{\s*({_NAME})\s*\}}|<%[=-]?\s*({_NAME})\s*-?%>|\{{%-?\s*(?:\w+\s+)?({_NAME})\s*-?%\}}"
    rf"|\*\|\s*({_NAME})\s*\|\*|\[\[\s*({_NAME})\s*\]\]|<<\s*({_NAME})\s*>>|@@\s*({_NAME})\s*@@|(?i:&lt;)\s*({_NAME})\s*(?i:&gt;)|«\s*({_SNAKE}|[A-Z][A-Z0-9]{{2,}})\s*»"
    rf"|(?<![\w%])%({_NAME})%(?![\w%])|(?<!\w)__({_NAME}?)__(?!\w)|(?<![\w$])\$([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)\b(?![\w(/])|(?<![\w%])%(?:\d\$)?([sd])(?!\w)|(?<![\w{{])\{{(\d)\}}(?!\w)"
    rf"|[<\[{{]\s*({_SNAKE}|(?:[A-Z][A-Z0-9]*[ _]?)+(?<=[A-Z0-9]{{3}}))\s*[>\]}}]|[\[<]\s*(?i:insert|enter|add|your|type|todo|tbd|fixme)\b\s*:?\s*({_NAME})?\s*[\]>]|\[\s*({_NAME})\s+(?i:goes here|here)\s*\]"
)
#: Brackets that hold one word or two: a slot only if the word is a variable of other records, or if they fill it.
_MAYBE = re.compile(r"[{<«]\s*([A-Za-z]{3,}(?: [A-Za-z]{2,})?)\s*[}>»]|\[\s*([A-Za-z]{3,}(?: [A-Za-z]{2,})?)\s*\]")
#: Values without marks, which count only where other records fill the same slot.
_UNFILLED = re.compile(
    rf"(?<![\w/.$%@]){_SNAKE}(?![\w(/.@])|(?<![\w-])(?i:tbd|tba|undefined|null|nan|untitled|unnamed)(?![\w-])"
    r"|(?<!\w)_{2,}(?!\w)|\[\s*\]|\{\s*\}|<\s*>|(?<!\S)\?{2,}(?!\S)"
)
#: A label whose value is blank, or a blank that stands for words twice in a paragraph.
_BLANK = re.compile(r"\b\w+\s*:\s*(?:_{4,}|\[\s*\]|<\s*>)(?=\s|$)|\(\s*_{3,}\s*\)|(?<!\w)_{4,}(?!\w)[^\n]*(?<!\w)_{4,}(?!\w)")
#: A label or counted heading whose whole value stands in brackets.
_FORM_VALUE = re.compile(r"^[^:.!?]{1,30}:\s*([(\[<{][^()\[\]<>{}]{5,60}[)\]>}])$")
#: Words before or after a slot that speak about it, or quotes and code marks around it.
_SPEAKS_BEFORE = re.compile(
    r"(?:[`'\"“”„‘’]|\b(?:such as|(?:shell |environment )?variables?|called|named|placeholders?|symbols?|tokens?|macros?|the (?:string|tag|marker|mark|notation|syntax)|for example|e\.g\.|written|spelled"
    r"|wie etwa|namens|genannt|platzhalter|variable|par exemple|appelée?s?|por ejemplo|llamad[oa]s?)[\s:,'\"“„«(]*)$",
    re.I,
)
_SPEAKS_AFTER = re.compile(r"^(?:[`\"”’]|[\s'”»),]*\b(?:stood for|stands? for|means|denotes|is replaced|steht für|signifie|significa)\b)", re.I)

# Wording of messages in English, German, French and Spanish, by what it expresses; one expression
# between bars each, in which * stands for any ending. Nothing counts by one of them alone.
#: Failure of a system.
_FAIL = (
    "error|errors|not found|not exist|doesn't exist|not available|not allowed|not permitted|not authori*|not supported|not responding|fail|failed|failure|denied|forbidden|unauthori*|expired|timed out|time-out|timeout"
    "|unavailable|went wrong|oops|sorry|down for|maintenance|too many|exceeded|fatal|undefined|uncaught|unhandled|exception|bad gateway|bad request|no permission|out of memory|overloaded|suspended|not implemented"
    "|been moved|been removed|been renamed|been deleted|fehler|nicht gefunden|nicht vorhanden|nicht verfügbar|nicht erreichbar|nicht erlaubt|nicht möglich|nicht mehr vorhanden|nicht mehr verfügbar|existiert"
    "|verweigert|abgelaufen|wartung*|gesperrt|ungültig*|fehlgeschlagen|schiefgelaufen|zu viele|erreur|introuvable|n'existe|refusé*|expiré*|indisponible|interdit|échoué*|échec|désolé|désolés|trop de|pas été trouvé*"
    "|no existe|no está disponible|no disponible|no se ha podido|no se pudo|no se encuentra|no se encontró|no se ha encontrado|denegad*|caducad*|expirad*|prohibid*|falló|fallado|lo sentimos|demasiad*|mantenimiento"
)
#: What is not possible; it fails only together with one of _THING or _SCRIPT.
_CANNOT = "cannot|can't|could not|couldn't|unable to|can not|no longer|invalid|nicht mehr|konnte nicht|konnte leider nicht|kann nicht|n'est pas|n'est plus|impossible|ne peut|n'avez pas|no puede|no se puede|no responde|interrupted|interrompue"
#: Things that fail on the web or in a program.
_THING = (
    "page|pages|webpage|web page|website|web site|site|url|link|server|web server|browser|database|session|account|request|requests|requested|connection|network|service|login|gateway|proxy|http"
    "|seite|webseite|adresse|sitzung|konto|anfrage|verbindung|datenbank|dienst|fichier|serveur|compte|requête|connexion|base de données|accès|zugriff|access|página|sitio|archivo|servidor|cuenta|sesión|solicitud|conexión|base de datos|acceso"
)
_SCRIPT = "javascript|java script|script|scripts|scripting|cookie|cookies|noscript|browser|navigateur|navegador"
#: What scripts and cookies must be.
_REQUIRE = (
    "enable|enabled|activate|activated|turn on|turned on|turned off|switch on|switched on|switched off|allow|allowed|accept|require|required|requires|need|needs|needed|must be|disabled|blocked|without|checking|check your"
    "|aktivier*|einschalten|eingeschaltet|zulassen|erforderlich|benötigt|müssen|ohne|activer|activez|activé|autoris*|nécessaire|nécessite|requis|sans|activar|active|habilit*|permit*|necesari*|requier*|debe"
)
#: Words that address the visitor.
_ADDRESS = (
    "please|you requested|you asked|you are looking|you are not|you do not|you don't|you have|you need|you must|your|we can't|we cannot|we could not|we couldn't|try again|again later|reload|refresh|retry|sign in|log in|come back|check back|go back|return to|this page|this site|this website|this reader|this server|this archive"
    "|bitte|ihre|ihr|erneut|veuillez|votre|réessay*|recharg*|usted|vuelva|inténtelo|intente|por favor"
)
#: Text that asks to be replaced.
_DEFAULT = (
    "goes here|text here|click to edit|click here to edit|click to add|replace this|to be supplied|to be added|to be provided|to be completed|placeholder|sample text|sample paragraph|sample title|dummy text|dummy paragraph|filler text"
    "|coming soon|under construction|blindtext|platzhalter|beispieltext|mustertext|richtigen text|texte provisoire|texte factice|texte de remplissage|à compléter|saisir ici|texto provisional|texto de relleno|texto de ejemplo|texto de prueba|sustituya"
)
#: Its company, and what it calls itself.
_FILL_IN = "your|here|click|edit|replace|insert|enter|type|ersetzen|einfügen|hier|ici|saisir|remplacer|remplacez|insérer|aquí|introduzca|escriba|inserte|estas|definitiva|définitive"
_ITSELF = "text|texts|title|name|content|description|descriptions|paragraph|caption|heading|block|wording|words|page|details|titel|absatz|inhalt|beschreibung|texte|titre|contenu|légende|texto|título|párrafo|contenido|descripción|líneas"
#: Records of programs: status lines, traces and their exceptions.
_PROGRAM = re.compile(
    r"^http/\d(?:\.\d)? \d{3}\b|^traceback \(most recent call last\)|^(?:fatal |parse |syntax |uncaught |internal )*(?:error|exception|erreur|fehler)(?: \d+)?\s*: |^\w*(?:error|exception): |^file \".*\", line \d+"
    r"|^at [\w.$]+\([\w.]+:\d+\)|^warning: \w+\(\)|\bcall to undefined (?:function|method)\b|\bstack trace:|\bsegmentation fault\b|^exception in thread\b|<noscript>"
)
#: A number of a status line or of an error before its wording.
_STATUS = re.compile(r"^(?:(?:http |server )?(?:error|erreur|fehler|código)\s*)?(?:code )?[45]\d\d\b(?! ?[.,]\d)|\bcode \d+\b")
#: A sentence that speaks about such things.
_REPORTS = re.compile(r"\b(?:explain(?:s|ed)?|means?|meant|says?|said|wrote|writes|describe[sd]?|report(?:s|ed)|mention(?:s|ed)?|denotes?|erklärt|bedeutet|sagte|explique|signifie|explica|significa|dijo)\b")
# Words of the usual filler text; further ones are learned from its neighbours.
_CLASSIC = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip
    commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum""".split()
)
#: Share of filler words in a sentence that counts; words of the usual text, and their share, in a paragraph from which further ones are learned.
FILLER_SHARE, RICH_WORDS, RICH_SHARE = 0.5, 4, 0.1


def _of(words: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w).replace(r"\*", r"\w*") for w in words.split("|")) + r")(?!\w)")


_RE_FAIL, _RE_CANNOT, _RE_THING, _RE_SCRIPT, _RE_REQUIRE, _RE_ADDRESS = map(_of, (_FAIL, _CANNOT, _THING, _SCRIPT, _REQUIRE, _ADDRESS))
_RE_DEFAULT, _RE_FILL_IN, _RE_ITSELF = map(_of, (_DEFAULT, _FILL_IN, _ITSELF))
_BARE_NEED = re.compile(r"\b(?:required|erforderlich|requis|necesario|blocked|disabled)\b")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CODE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\d+")
_WORDS = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_RUN = re.compile(r"(?:^|\s)((?:\S{1,12}\s+){1,3}?)\1\1")
#: Marks of which any slot has one.
_MARKS = ("{", "<", "[", "@@", "«", "_", "&lt;", "&LT;", "$", "*|", "??")
#: Words of a line besides a slot, at most, if the line is a form of its own (a label, a salutation).
FORM_WORDS = 4
#: Characters of text on either side of a slot in which the words around it are looked for.
AROUND_CHARS = 200


def wording(unit: str) -> tuple[int, bool, bool]:
    """(hits, lone, default) of one lower-case page, paragraph or line.

    hits: different expressions of failure, system, script need or default text, 0 if none of them fails, needs or
    asks to be replaced; lone: unmistakable without another record; default: default text rather than a message.
    """
    replace = set(_RE_DEFAULT.findall(unit))
    m = _FORM_VALUE.match(unit)
    if replace and (m or len(set(_RE_FILL_IN.findall(unit)) | replace) >= 2) and _RE_ITSELF.search(unit):
        return 2 + len(replace), True, True
    if _PROGRAM.search(unit):
        return 3, not _REPORTS.search(unit), False
    fail, script, thing = set(_RE_FAIL.findall(unit)), set(_RE_SCRIPT.findall(unit)), set(_RE_THING.findall(unit))
    if thing or script:
        fail |= set(_RE_CANNOT.findall(unit))
    need = {x for s in _SENTENCE.split(unit) if _RE_SCRIPT.search(s) for x in _RE_REQUIRE.findall(s)}
    if not fail and not need:
        return 0, False, False
    told_of = (_RE_FAIL, _RE_CANNOT, _RE_THING, _RE_SCRIPT, _RE_ADDRESS, _STATUS)
    sentences = [(len(s.split()), any(x.search(s) for x in told_of)) for s in _SENTENCE.split(unit)]
    if 3 * sum(n for n, hit in sentences if not hit) > sum(n for n, _ in sentences):
        return 0, False, False  # most of it speaks of something else
    address, status = bool(_RE_ADDRESS.search(unit)), bool(_STATUS.search(unit))
    hits = len(fail | thing | script | need) + address + status
    fragment = any(len(s.split()) <= 4 and _RE_FAIL.search(s) for s in _SENTENCE.split(unit))
    # a failure told to the visitor, or the failure of a page, server or session itself, or a need of scripts
    told = fail and (address and (thing or script or fragment or len(fail) > 1) or fragment and status)
    itself = fail and thing and (fragment or status or len(fail | thing) >= 4 or len(unit.split()) <= 8)
    needed = need and (script - {"browser"} and (address or _BARE_NEED.search(unit)) or len(need) > 1 or address and len(script | need) >= 3)
    return hits, bool(told or itself or needed) and not _REPORTS.search(unit), False


def _near(units: list[str], first: int, last: int) -> str:
    """What stands around units ``first`` to ``last``; the same in copies of one text that were edited elsewhere."""
    return (units[first - 1][-30:] if first else "") + "|" + (units[last + 1][:30] if last + 1 < len(units) else "")


def _units(text: str) -> Iterator[tuple[str, bool, str]]:
    """(unit, whether it stands alone, what is around it): the page, its paragraphs, its lines, and up to four lines that hold whole sentences."""
    yield " ".join(text.split()), True, ""
    paras = [" ".join(x.split()) for x in _PARAGRAPH.split(text)]
    for k, para in enumerate(_PARAGRAPH.split(text)):
        yield paras[k], True, _near(paras, k, k)
        lines = [" ".join(x.split()) for x in para.split("\n") if x.strip()]
        if len(lines) < 2:
            continue
        for i, x in enumerate(lines):
            opens = not x[0].islower() and (i == 0 or lines[i - 1][-1:] in ".!?|:>")
            yield x, opens and (x[-1] in ".!?>)" or i == len(lines) - 1), _near(lines, i, i)
            for j in range(i + 2, min(len(lines), i + 4) + 1):
                if opens and lines[j - 1][-1] in ".!?":
                    yield " ".join(lines[i:j]), False, _near(lines, i, j - 1)


Trace = tuple[str, bool, bool, str, str, str, str]


def messages(text: str) -> list[Trace]:
    """(kind, lone, page, template, value, before, after) of every unit of a folded text with wording of a message or default."""
    out = {}
    size = len(text.split())
    for unit, alone, near in _units(text):
        n = unit.count(" ") + 1
        if len(unit) > UNIT_CHARS or n > UNIT_WORDS:
            continue
        low = unit.lower()
        hits, lone, default = wording(low)
        if hits and (hits > 1 or n >= 7 or low[-1:] in ".!?"):
            out[("default" if default else "message", lone and (alone or bool(_PROGRAM.search(low))), 2 * n >= size, _CODE.sub("0", low), "", near.lower(), "")] = None
    return list(out)


def slots(text: str) -> list[Trace]:
    """(kind, lone, page, template, value, before, after) of every place of a folded text that holds an unfilled value.

    kind: slot (marks of templates), weak (ordinary brackets), open (no marks), blank; template: the rest of the
    line if that is a form of its own; before, after: the text around it, without other slots.
    """
    out = {}
    taken: list[tuple[int, int, str, str]] = []
    for pattern, kind in ((_SLOT, "slot"), (_MAYBE, "weak"), (_UNFILLED, "open")):
        used = bytearray(len(text))
        for a, b, _, _ in taken:
            used[a:b] = b"\1" * (b - a)
        for m in pattern.finditer(text):
            if not any(used[m.start() : m.end()]):
                name = next((g for g in m.groups() if g), "") if kind != "open" else m.group()
                taken.append((m.start(), m.end(), kind, re.sub(r"[_ .:-]+", "_", name.lower())))
    taken.sort()
    # the text with blanks for all slots, so that the words around one are never another
    plain = list(text)
    for a, b, _, _ in taken:
        plain[a:b] = " " * (b - a)
    plain = "".join(plain)
    if _BLANK.search(text):
        out[("blank", True, False, "", "", "", "")] = None
    for a, b, kind, name in taken:
        if _SPEAKS_BEFORE.search(text[max(0, a - 40) : a]) or _SPEAKS_AFTER.match(text[b : b + 40]):
            continue
        before, after = plain[max(0, a - AROUND_CHARS) : a], plain[b : b + AROUND_CHARS]
        first = before.rsplit("\n", 1)[-1]
        rest = _CODE.sub("0", " ".join(_WORDS.findall((first + " " + after.split("\n", 1)[0]).lower())))
        if kind == "open" and len(_WORDS.findall(_SENTENCE.split(first)[-1])) > 3:
            continue  # a bare identifier or "null" deep in a sentence is ordinary text
        out[(kind, kind == "slot", False, rest if 0 < rest.count(" ") + 1 <= FORM_WORDS and rest else "", name, before, after)] = None
    return list(out)


def _runs(text: str) -> bool:
    """A line of one to three words said over and over."""
    for line in text.lower().split("\n"):
        words = line.split()
        if len(words) >= 6 and len(set(words)) <= 3 and _RUN.search(" ".join(words) + " "):
            return True
    return False


def _stems(*words: str) -> list[str]:
    """Literals of which every text that holds one of the expressions has one."""
    stems = {w.split("*")[0] for w in "|".join(words).split("|")}
    return sorted(x for x in stems if not any(y != x and y in x for y in stems))


_GATE = _stems(_FAIL, _DEFAULT, "script|cookie|browser|navigateur|navegador|traceback|http/|stack trace|segmentation|warning:", " tbd|:tbd| tba| undefined| null| nan|untitled|unnamed")
_GATE_CANNOT, _GATE_THING = _stems(_CANNOT), _stems(_THING)


def _suspect(text: str, low: str) -> Column:
    """A text that ``messages``, ``slots`` or ``_runs`` may find something in; literals searched in the JVM. low: lower-case column."""
    any_of = lambda c, words: reduce(lambda x, y: x | y, [F.contains(F.col(c), F.lit(w)) for w in words])
    worded = any_of(low, _GATE) | any_of(low, _GATE_CANNOT) & any_of(low, _GATE_THING)
    run = F.exists(F.split(low, "\n"), lambda x: F.exists(F.array(F.split(x, " ")), lambda w: (F.size(w) >= 6) & (F.size(F.array_distinct(w)) <= 4)))
    percent = F.contains(text, F.lit("%")) & F.col(text).rlike("%[A-Za-z_ ]{2,40}%|%(?:[0-9]\\$)?[sd]\\b")
    return any_of(text, _MARKS) | worded | percent | run


def _tokens(text: Column) -> Column:
    """Lower-case words as they are set off by blanks, numbers masked; an array that begins with '.'."""
    return F.split(F.concat(F.lit(". "), F.trim(F.regexp_replace(F.lower(text), "[0-9]+", "0"))), "\\s+")


def _aligned(texts: DataFrame, places: DataFrame, min_support: int) -> DataFrame:
    """(place, how): the places whose surrounding words stand in other texts around another filling, or around none.

    texts: _h, _t; places: place, _h, before, after, fill (whether fillings are looked for). Without a filling (none), three words across the place, of
    which the first may be any end of a sentence, must run on in ``min_support`` texts. With one (filled) of at most
    VALUE_WORDS words, the words on either side (two after; three before, or the one since the last end of a sentence)
    must stand around two different fillings. Texts that hold the place itself do not support it. Only hashes of words
    at places are kept, by a join whose small side the planner may broadcast.
    """
    got = F.get
    stops = lambda w: F.endswith(w, F.lit(".")) | F.endswith(w, F.lit(":")) | F.endswith(w, F.lit("?")) | F.endswith(w, F.lit("!")) | F.endswith(w, F.lit("|"))
    ends = lambda w: F.when(stops(w), F.lit(".")).otherwise(w)
    word = lambda w: F.coalesce(w.rlike("\\p{L}"), F.lit(False)).cast("int")
    sides = places.select("place", "_h", "fill", F.filter(_tokens(F.col("before")), lambda w: w != "").alias("b"), F.concat(F.slice(_tokens(F.col("after")), 2, 9999), F.array(F.lit("."))).alias("a"))
    sides = sides.withColumn("a", F.filter("a", lambda w: w.rlike("[\\p{L}0.]")))
    n = F.size("b")
    l3, l2, l1, r1, r2 = got("b", n - 3), got("b", n - 2), got("b", n - 1), got("a", F.lit(0)), got("a", F.lit(1))
    span = F.when(word(l1) + word(r1) + word(r2) >= 2, F.xxhash64(ends(l1), r1, r2)).when(word(l2) + word(l1) + word(r1) >= 2, F.xxhash64(ends(l2), l1, r1))
    left = F.when(stops(l1) & ~F.endswith(l1, F.lit(":")), None).when(stops(l2), F.xxhash64(F.lit(2), l1)).otherwise(F.xxhash64(ends(l3), l2, l1))
    keyed = sides.select("place", "_h", span.alias("span"), F.when(F.col("fill") & (word(l1) + word(r1) + word(r2) >= 2), left).alias("left"), F.xxhash64(r1, F.coalesce(r2, F.lit("."))).alias("right"))
    keyed = materialize(keyed)
    wanted = keyed.select(F.explode(F.array("span", "left")).alias("x")).where("x is not null").distinct()
    w = texts.select("_h", F.concat(_tokens(F.col("_t")), F.array(F.lit("."))).alias("w"))
    runs = w.select("_h", "w", F.slice("w", 2, F.size("w")).alias("w2"), F.slice("w", 3, F.size("w")).alias("w3"))
    runs = runs.select("_h", F.posexplode(F.arrays_zip("w", "w2", "w3")).alias("i", "z")).select("_h", "i", "z.w", "z.w2", "z.w3")
    # at: the position after the words
    begun = F.when(stops(F.col("w")), F.struct(F.xxhash64(F.lit(2), "w2").alias("x"), (F.col("i") + 2).alias("at")))
    runs = runs.select("_h", F.explode(F.array_compact(F.array(F.struct(F.xxhash64(ends(F.col("w")), "w2", "w3").alias("x"), (F.col("i") + 3).alias("at")), begun))).alias("e"))
    runs = materialize(runs.select("_h", "e.*").join(wanted, "x", "left_semi"))
    each = keyed.select("place", F.col("span").alias("x")).where("x is not null").distinct()
    none = runs.select("x", "_h").distinct().join(each.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    without = each.join(none, "x", "left_semi").select("place")
    both = keyed.where("left is not null").select("left", "right", "_h").distinct()
    begins = runs.join(both.select(F.col("left").alias("x")).distinct(), "x", "left_semi").select("_h", F.struct(F.col("x").alias("left"), "at").alias("b"))
    follow = w.join(begins.groupBy("_h").agg(F.collect_set("b").alias("b")), "_h").select("_h", "w", F.explode("b").alias("b"))
    follow = follow.select("_h", "b.left", F.slice("w", F.col("b.at") + 1, VALUE_WORDS + 2).alias("f"))
    follow = follow.select("_h", "left", got("f", F.lit(0)).alias("first"), F.explode(F.array(*[F.xxhash64(got("f", F.lit(k)), got("f", F.lit(k + 1))) for k in range(1, VALUE_WORDS + 1)])).alias("right"))
    filled = follow.join(both.select("left", "right").distinct(), ["left", "right"], "left_semi").join(both, ["left", "right", "_h"], "left_anti")
    varied = filled.groupBy("left", "right").agg(F.countDistinct("_h").alias("n"), F.countDistinct("first").alias("values")).where((F.col("n") >= min_support) & (F.col("values") > 1))
    other = keyed.join(varied, ["left", "right"], "left_semi").select("place")
    return without.select("place", F.lit("none").alias("how")).unionByName(other.select("place", F.lit("filled").alias("how"))).distinct()


def _squeezed(text: Column) -> Column:
    """Lower case, numbers and codes masked, lines trimmed; paragraph and line breaks stay."""
    return F.regexp_replace(F.lower(text), "[0-9a-f]*[0-9][0-9a-f]*", "0")


def _page_templates(texts: DataFrame, min_support: int) -> DataFrame:
    """(_k): records that are, or hold as a line or paragraph, a text that is the whole of ``min_support`` records and stands in as many others."""
    one = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    pages = texts.where(F.length("_t") <= UNIT_CHARS).select("_k", one(_squeezed(F.col("_t"))).alias("u")).where(F.contains("u", F.lit(" ")) & F.col("u").rlike("\\p{L}"))
    pages = pages.select("_k", F.xxhash64("u").alias("u"))
    often = materialize(pages.distinct().groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("u"))
    low = texts.select("_k", "_h", F.explode(F.array(_squeezed(F.col("_t")))).alias("t"))
    units = F.array_distinct(F.transform(F.filter(F.concat(F.split("t", "\\n[^\\S\\n]*\\n"), F.split("t", "\\n")), lambda u: F.length(u) <= UNIT_CHARS), one))
    inside = low.where(F.contains("t", F.lit("\n"))).select("_k", "_h", F.explode(units).alias("u")).select("_k", "_h", F.xxhash64("u").alias("u"))
    inside = materialize(inside.join(often, "u", "left_semi"))
    shared = inside.select("u", "_h").distinct().groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("u")
    return inside.select("_k", "u").unionByName(pages).join(shared, "u", "left_semi").select("_k")


def _filler(texts: DataFrame, min_support: int) -> DataFrame:
    """(_k): records with a sentence of filler text.

    A sentence of at least four words counts if half of them are filler words: those of the usual text, and
    those that stand, in records with that text, almost only (four fifths) in paragraphs rich in it.
    """
    some = texts.where(reduce(lambda x, y: x | y, [F.contains(F.lower("_t"), F.lit(w)) for w in ("lorem", "ipsum", "dolor ", " amet")]))
    classic = F.array(*[F.lit(w) for w in sorted(_CLASSIC)])
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{M}]+"), lambda w: w != "")
    paras = some.select("_k", "_h", F.posexplode(F.split("_t", "\\n[^\\S\\n]*\\n")).alias("p", "para")).withColumn("w", words(F.col("para")))
    usual = F.size(F.filter("w", lambda w: F.array_contains(classic, w)))
    paras = materialize(paras.where(F.size("w") > 3).withColumn("rich", (usual >= RICH_WORDS) & (usual >= RICH_SHARE * F.size("w"))))
    seen = paras.select("_h", "p", "rich", F.explode(F.array_distinct("w")).alias("w")).distinct()
    learned = seen.groupBy("w").agg(F.count(F.when(F.col("rich"), 1)).alias("inside"), F.count("*").alias("n"), F.countDistinct("_h").alias("texts"))
    learned = learned.where((F.col("inside") >= 0.8 * F.col("n")) & (F.col("texts") >= min_support)).select("w")
    sentences = paras.select("_k", "_h", "p", F.posexplode(F.split("para", "(?<=[.!?])\\s+")).alias("s", "text")).withColumn("w", words(F.col("text"))).where(F.size("w") > 3)
    each = sentences.select("_k", "p", "s", F.explode("w").alias("w")).join(learned.withColumn("known", F.lit(True)), "w", "left")
    filler = F.col("known").isNotNull() | F.array_contains(classic, F.col("w"))
    return each.groupBy("_k", "p", "s").agg(F.avg(filler.cast("double")).alias("share")).where(F.col("share") >= FILLER_SHARE).select("_k")


def residue_evidence(documents: DataFrame, key: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT) -> DataFrame:
    """(key, kind, basis): what residue each document has (slot, blank, default, filler, message) and on what grounds.

    basis: slot (induced by alignment), template (repeated page, line or paragraph), filler (filler vocabulary), lone
    (unmistakable, no other record shares it). Documents delivered twice count once; documents of equal text count
    once as support, but each if the unit is at least half of the text, as in an error page served under many
    keys. Null keys and null or empty texts give no row. Letter case, look-alikes and wrapped lines make no difference.
    """
    fields = {f.name: f for f in documents.schema.fields}
    # exploding one value keeps the planner from repeating the fold in every term of the filter
    texts = documents.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_k"), F.explode(F.array(fold(F.col(text)))).alias("_t"))
    texts = texts.select("_k", F.xxhash64("_t").alias("_h"), "_t")
    schema = T.StructType(
        [T.StructField("_k", fields[key].dataType), T.StructField("_h", T.LongType()), T.StructField("kind", T.StringType())]
        + [T.StructField("lone", T.BooleanType()), T.StructField("page", T.BooleanType())]
        + [T.StructField(c, T.StringType()) for c in ("template", "value", "before", "after")]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h, t in zip(pdf["_k"], pdf["_h"], pdf["_t"]):
                out += [(k, h, *e) for e in (*messages(t), *slots(t))]
                if _runs(t):
                    out.append((k, h, "filler", True, False, "", "", "", ""))
            yield pd.DataFrame(out, columns=schema.names)

    lowered = texts.select("*", F.explode(F.array(F.lower("_t"))).alias("_l"))
    # the traces of the few documents that have any, written once for the uses below
    found = materialize(lowered.where(_suspect("_t", "_l")).drop("_l").mapInPandas(run, schema).distinct())
    # templates: copies of one page are as many records if the unit is the page, and one if it stands between the same words
    told = found.where("kind in ('message', 'default')")
    by = told.select("template", F.when(F.col("page"), F.xxhash64("_k", F.lit(1))).otherwise(F.xxhash64("before")).alias("by")).distinct()
    repeated = by.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("template", F.lit("template").alias("basis"))
    units = told.join(repeated, "template", "left").where("lone or basis is not null").select("_k", "kind", F.coalesce("basis", F.lit("lone")).alias("basis"))
    # slots
    places = found.where("kind in ('slot', 'weak', 'open')").withColumn("place", F.xxhash64("template", "before", "after"))
    # marks in running text are insertions; in a form of its own, and for what has no marks, other fillings are looked for too
    fill = (F.col("kind") != "slot") | (F.col("template") != "")
    # parts are written one after the other: a single plan of them all would run every branch at once and fill the driver
    aligned = _aligned(texts, places.select("place", "_h", "before", "after", fill.alias("fill")).distinct(), min_support)
    how = materialize(aligned.groupBy("place").agg(F.max(F.col("how") == "filled").alias("filled")))
    forms = places.where("kind = 'slot' and template <> ''").groupBy("template").agg(F.countDistinct("_h").alias("n"), F.countDistinct("value").alias("v"))
    forms = forms.where((F.col("n") >= min_support) & (F.col("v") > 1)).select("template", F.lit(True).alias("form"))
    names = places.where("kind = 'slot' and value <> ''").groupBy("value").agg(F.countDistinct("_h").alias("n")).where(F.col("n") >= min_support).select("value", F.lit(True).alias("name"))
    p = places.join(how, "place", "left").join(forms, "template", "left").join(names, "value", "left")
    induced = F.when(F.col("kind") == "slot", F.col("filled").isNotNull() | F.col("form").isNotNull())
    induced = induced.when(F.col("kind") == "weak", F.coalesce("filled", F.lit(False)) | F.col("name").isNotNull()).otherwise(F.coalesce("filled", F.lit(False)))
    taken = materialize(p.where(induced | F.col("lone")).select("_k", F.lit("slot").alias("kind"), F.when(induced, "slot").otherwise("lone").alias("basis")))
    rest = found.where("kind in ('blank', 'filler')").select("_k", "kind", F.lit("lone").alias("basis"))
    pages = materialize(_page_templates(texts, min_support).distinct()).select("_k", F.lit("message").alias("kind"), F.lit("template").alias("basis"))
    filler = materialize(_filler(texts, min_support).distinct()).select("_k", F.lit("filler").alias("kind"), F.lit("filler").alias("basis"))
    out = units.unionByName(taken).unionByName(rest).unionByName(pages).unionByName(filler)
    return out.withColumnRenamed("_k", key).distinct()


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT) -> DataFrame:
    """(key, kind): documents with residue and what it is, one row each; as ``residue_evidence``."""
    return residue_evidence(documents, key, text, min_support).select(key, "kind").distinct()


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without those of ``find_residue``; all columns, and rows of null key or text, are kept."""
    bad = find_residue(documents, key, text).select(F.col(key).alias("__residue_key")).distinct()
    return documents.join(bad, documents[key] == F.col("__residue_key"), "left_anti")
