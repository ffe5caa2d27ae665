"""Leftovers of templates, filler text, error pages and script notices.

A text is looked at in units: its lines, and within a line its sentences.  A
unit is a case if it holds an unfilled placeholder by one of the grammars below
(one grammar per kind of delimiter), filler, or an error or script message that
starts the unit.  A unit does not count if its surroundings speak about such a
thing: it is quoted, stands in a code block, or its words explain, report or
name it.  Filler is also found by density: runs of one word, and sentences of
pseudo-Latin without function words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.literals import fold, required

_NAME = r"[A-Za-z_][\w.]{0,40}"
_WORDS = r"[A-Za-z][\w'-]*(?:[ _][\w'-]+){0,5}"

# one grammar per delimiter
PLACEHOLDERS = {
    "double_curly": rf"\{{\{{\{{?\s*[#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}]{{0,40}})?\s*\}}?\}}\}}",
    "block_tag": r"\{%-?\s*\w+[^{}%]{0,60}-?%\}",
    "server_tag": r"<%[=-]?\s*[^%<>]{1,60}%>",
    "shell": rf"\$\{{\s*{_NAME}\s*\}}",
    "ruby": rf"#\{{\s*{_NAME}\s*\}}",
    "percent": r"%%[A-Za-z][A-Za-z_]{1,40}%%",
    "percent_name": r"%\([A-Za-z_]\w{0,40}\)[sdifr]",
    "at": r"@@[A-Za-z]\w{1,40}@@",
    "underscores": r"(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)",
    "dollar": r"(?<![\w$])\$[A-Z][A-Z_]{1,40}\$(?![\w$])",
    "double_square": rf"\[\[\s*{_WORDS}\s*\]\]",
    "double_angle": rf"<<\s*{_WORDS}\s*>>",
    "guillemets": r"«[a-zA-Z_]+(?:[ _][a-zA-Z_]+){0,3}Â?»",
    "escaped_angle": r"&lt;[A-Za-z_]+(?:[ _][A-Za-z_]+){0,3}&gt;",
    "upper_angle": r"<[A-Z][A-Z_]*(?:[ _][A-Z]+){0,3}>",
    "angle_order": r"<(?:insert|enter|add|your|type|fill in|put|name of|date of)\b[^<>\n]{0,40}>",
    "square_order": r"\[(?:insert|enter|add|your|type|fill in|put|choose|select|hier|bitte|introducir|insertar|escriba|ins[eé]rer|saisir|entrer|indiquer|votre|su|ihr)\b[^\[\]\n]{0,50}\]",
    "square_todo": r"\[[^\[\]\n]{1,40}\b(?:to be (?:completed|added|filled in|determined|inserted|confirmed)|tbd|tbc|todo|here|hier|aqu[ií]|ici|eintragen|einfügen|ausfüllen|à compléter|por completar|completar)\]",
    "round_order": r"\((?:fill in|insert|enter|add|your)\b[^()\n]{0,40}\)",
    "single_curly": r"(?<![\w\])}$#{%\\])\{(?:[a-z_][a-z_0-9]{1,30}|[A-Z][A-Z_]{2,30}|0)\}(?!\})",
    "object": r"\[object Object\]",
}
# the reply of a document that is about such things: fixed words of reports, manuals and quotations
ABOUT = (
    r"stands? for|placeholders?|naming (?:scheme|rule|convention)|replace[sd]? (?:\S+ ){0,4}by|is (?:now )?called|(?:are|is|was|were) written|can write|may write|filled (?:it|them) in|the (?:manual|syntax|pattern|regex|mask|"
    r"notation|variable|column|field|expression|format|tag|message|notice|warning|string|error message|macro|option|token)s? (?:\S+ ){0,2}?$|was used to trim|used to contain|we removed|has been tested|for example|e\.g\.|such as|means?\b|expands? to|renders?|substitut|docs?\b|documentation|tutorial|syntax|escaped? as|regular expression|"
    r"whenever|we fixed|was fixed|fixed the|reports? load|the cause|the rerun|asked what|we told|a user|the export|the loader|the parser|the script\b"
)
# whole messages, which begin a line or a sentence
MESSAGES = {
    "status_line": r"(?:error|http(?:/\d(?:\.\d)?)?(?: status)?|status|fehler|erreur|error de servidor|código|code)\s*:?\s*[-–]?\s*[45]\d\d\b(?!\s*,\d)\s*(?:[:–—-]|$|[A-Z][a-z]+|\()",
    "status_first": r"[45]\d\d\s*[:–—-]?\s*(?:forbidden|not found|bad gateway|bad request|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway time-?out|gone|method not allowed|too many requests|page not found|error)\b",
    "status_name": r"(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|page not found|file not found|404 not found)\s*[.!]?\s*$",
    "not_found": r"we looked everywhere\b|(?:oops|sorry|uh oh|whoops)\b.{0,60}(?:page|link|address|record|doesn.t exist|does not exist|went wrong|cannot be found|could not be found)|(?:the )?(?:requested )?(?:page|url|address|resource|document|file) (?:you (?:requested|are looking for|were looking for|asked for)|/\S+ |requested )?.{0,40}(?:could not be (?:found|served|loaded)|cannot be found|was not found(?: on this server)?|does not exist|no longer exists|has (?:been )?(?:moved|removed))|(?:the )?(?:item|entry|record|article|content|link|report) (?:that )?you (?:requested|asked for|are looking for|were looking for|tried to (?:open|reach)|followed)\b.{0,40}(?:found|exists?(?:ed)?|withdrawn|moved|removed|deleted|expired|(?:no longer |not |un)available)|the requested url\b",
    "not_found_other": r"seite (?:wurde )?nicht gefunden|(?:die )?(?:angeforderte )?seite (?:existiert|konnte) nicht|p[áa]gina no encontrada|la p[áa]gina (?:solicitada )?no (?:existe|se encuentra|se ha encontrado)|page (?:introuvable|non trouvée)|la page (?:demandée )?(?:est introuvable|n.existe (?:pas|plus))|zugriff verweigert|acc[eè]s (?:refusé|interdit)|acceso denegado|der dienst ist zurzeit|le service est (?:momentanément |temporairement )?indisponible|(?:el )?servicio no (?:est[áa] )?disponible|error interno del servidor|erreur interne|interner serverfehler",
    "denied": r"access (?:is |was )?denied\b|you (?:do not|don.t) have (?:the )?permission|permission denied\b|request blocked\b|your (?:request|access|ip)(?: address)? (?:has been|was) (?:blocked|denied)|unusual traffic\b|too many requests|you have been blocked",
    "human_check": r"(?:checking|verifying|verify|please verify|confirm|please confirm)(?: that)? you are (?:a )?human|checking your browser|ddos protection by|please complete the (?:security check|captcha)|one more step\b.{0,40}captcha",
    "session": r"your session (?:has )?(?:expired|timed out)|sign in again to continue|please (?:log|sign) in (?:again )?to (?:continue|view)|you (?:must|need to) (?:log|sign) in\b",
    "server": r"something went wrong\b|an? (?:unexpected|unknown|internal) error (?:has )?occurred|(?:could not|cannot|unable to|failed to) connect to (?:the )?(?:database|server|host)|error establishing a database connection|database (?:connection )?error|connection (?:refused|timed out|reset)|(?:this|the) (?:site|page|service|server) is (?:currently |temporarily )?(?:unavailable|down|offline|under maintenance)|we(?:.re| are) (?:currently )?(?:down|offline) for maintenance|(?:scheduled )?maintenance in progress|we.ll be back soon|(?:please )?go back or try again later|please try again later|(?:our|the) (?:team|engineers|administrators?|support staff) (?:has|have) been (?:automatically )?(?:notified|alerted)",
    "stack": r"traceback \(most recent call last\)|(?:fatal error|parse error|warning|notice|uncaught \w*error|uncaught exception|unhandled exception|segmentation fault)\s*:\s*(?:allowed memory|uncaught|syntax error|undefined|call to|cannot|maximum execution|include|require|mysql|unexpected|out of memory|core dumped)|(?:[a-z]+\.){2,}\w*(?:exception|error)\b|at (?:[\w$]+\.)+[\w$<>]+\([\w$]+\.java:\d+\)|\w+(?:error|exception): .{0,80}$|file \"[^\"\n]+\", line \d+, in \w+|stack trace:|allowed memory size of",
    "scripts": r"(?:please )?(?:enable|activate|turn on|switch on|allow)\s+(?:javascript|scripts?|cookies and javascript)\b|(?:javascript|scripts?|cookies and javascript)\s+(?:is|are|must(?: both)? be|seems? to be|has to be|have to be|needs? to be|appears? to be)\s+(?:currently )?(?:required|disabled|enabled|on|turned (?:on|off)|switched (?:on|off)|off|blocked|needed|necessary)|(?:this|the) (?:app|application|site|page|website|viewer|browser|tool|content|form|explorer)\b.{0,30} (?:requires?|needs?|runs only with|works only with|relies on|depends on)\s+(?:javascript|scripts?)|we.re sorry but .{1,60} (?:doesn.t|does not) work (?:properly )?without javascript|you need to (?:enable|allow|activate|turn on|switch on) (?:javascript|scripts?)|(?:your )?browser (?:does not|doesn.t) (?:support|allow|run) (?:javascript|scripts?)|your browser is blocking (?:the )?scripts|browser has (?:javascript|scripts?) (?:disabled|turned off)|loading\s*\.{2,}\s*if nothing happens|if nothing happens, your browser",
    "scripts_other": r"(?:bitte )?aktivieren sie (?:bitte )?(?:javascript|skripte)|bitte (?:schalten sie )?javascript|(?:diese|die) (?:anwendung|seite|website|app)\b.{0,20} (?:benötigt|erfordert|braucht|verlangt) (?:aktivierte |aktiviertes )?(?:skripte|javascript)|javascript (?:ist|muss|wird) (?:deaktiviert|aktiviert|benötigt|eingeschaltet)|(?:veuillez |merci d.)?activer (?:javascript|les scripts)|cette (?:page|application|site)\b.{0,20} (?:nécessite|requiert|exige|a besoin de) (?:javascript|les scripts|des scripts)|javascript (?:est|doit être) (?:désactivé|activé|requis|nécessaire)|active javascript|(?:por favor,? )?(?:active|habilite|activa|habilita) (?:javascript|los scripts)|(?:esta|la) (?:página|aplicación|web)\b.{0,20} (?:requiere|necesita) (?:javascript|scripts)|javascript (?:está|debe estar) (?:desactivado|activado|habilitado)|(?:necesita|debe) (?:activar|habilitar) javascript",
    "noscript": r"<noscript\b",
    "html_error": r"<title>\s*(?:[45]\d\d\b|error\b|(?:page )?not found|access denied|forbidden)",
    "filler": r"(?:this is )?(?:sample|dummy|filler|placeholder|example|demo|test) (?:text|paragraph|copy|content)\b(?!.{0,30}\b(?:was|were|has|had)\b).{0,80}(?:\breplace\b|layout|will (?:come|follow|be)|goes here|only\b|here\b|$)|(?:body copy|headline|caption|title|subtitle|text|content|copy|description|summary|abstract|your \w+) goes here|replace (?:this|me) (?:with|by) (?:your|the|a)\b|(?:click|tap) to (?:add|edit|enter|insert) (?:text|title|notes?|subtitle|content|caption)|start typing here|type (?:your text|something) here|(?:write|enter|put|type|add) your [\w ]{1,30} (?:in this box|here|below)\b|delete this (?:line|text|paragraph|section) (?:when|before|after|once)|insert (?:your )?(?:text|content|description) here|this (?:page|section|paragraph) (?:is )?intentionally left blank|text (?:to be )?(?:to )?follow(?:s)?\.?$|(?:content|text|page) coming soon",
    "filler_other": r"texto de relleno|aqu[ií] va (?:el|la|su|tu)\b|texto de (?:ejemplo|prueba|muestra)|faux[- ]texte|texte (?:de remplissage|d.exemple|factice)|remplacez ce (?:paragraphe|texte)|votre texte ici|(?:hier steht ein |dies ist ein )?blindtext\b|platzhaltertext|(?:dies ist ein )?(?:beispiel|muster|füll)text\b|hier (?:steht|kommt) (?:ihr|der|ein) (?:text|blindtext|inhalt)|ersetzen sie diesen (?:text|absatz)",
}
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco ullam laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
CORE_LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing aliqua ullam ullamco eiusmod incididunt veniam nostrud".split())
FUNCTION_WORDS = frozenset("the a an of to and was were is are it we i you they he she that this these with for from by on at as has have had be been but not or which after before der die das und ist war wurden wurde nicht mit auf von zu den dem ein eine le la les des du une un est été pour dans sur avec que el los las del y es fue fueron con por para una se lo".split())

_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS.values()), re.I)
_CASED = {k: re.compile(p) for k, p in PLACEHOLDERS.items() if k in ("underscores", "dollar", "upper_angle", "single_curly")}
_FREE = {k: re.compile(p, re.I) for k, p in PLACEHOLDERS.items() if k not in _CASED}
_ABOUT = re.compile(ABOUT, re.I)
_LEAD = r"(?:[\s>*#|•·–—-]|<[^<>]{0,60}>)*"
_MESSAGE = {k: re.compile(_LEAD + f"(?:{p})", re.I) for k, p in MESSAGES.items()}
_INSIDE = re.compile("|".join(MESSAGES[k] for k in ("noscript", "html_error")), re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[^\s])")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile(r"\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|„[^“\n]{0,200}“|`[^`\n]{1,200}`|‘[^’\n]{2,200}’")
_REPEAT = re.compile(r"(?<!\w)([^\W\d_]{2,10})(?:[\s,.;]+\1(?!\w)){4,}", re.I)
_DNA = re.compile(r"[ACGTN]+$", re.I)
_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)|<(pre|code)\b.*?</\1>", re.S | re.I)
#: Per pattern literals of which every match holds one, folded: a pattern is only run on a text that holds one of its own.
_IMPLIED = {k: tuple(sorted(required(p))) for k, p in (PLACEHOLDERS | MESSAGES).items()}
_IMPLIED["latin"] = tuple(sorted(CORE_LATIN))
#: All of them: a text without one of these, folded, is no case, unless it repeats a word.
HINTS = tuple(sorted({h for hints in _IMPLIED.values() for h in hints}))


def _units(text: str) -> Iterator[str]:
    for line in text.splitlines():
        if line.strip():
            yield from (s for s in _SENTENCE.split(line) if s.strip())


def _holds(low: str, hints: tuple[str, ...]) -> bool:
    for h in hints:
        if h in low:
            return True
    return False


def _placeholders(unit: str, kinds: list[str]) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind in kinds for m in (_FREE.get(kind) or _CASED[kind]).finditer(unit)]


def _repeats(low: str) -> bool:
    """Whether two neighbouring words are equal, as in every match of the pattern for repeated words."""
    words = low.replace(",", " ").replace(".", " ").replace(";", " ").split()
    return any(map(eq, words, words[1:]))


def _is_about(unit: str, spans: list[tuple[int, int]]) -> bool:
    """Whether the words around the spans explain or report them."""
    rest = unit
    for a, b in sorted(spans, reverse=True):
        rest = rest[:a] + " " + rest[b:]
    return bool(_ABOUT.search(" ".join(rest.split())))


def _pseudo_latin(words: list[str]) -> bool:
    return len(words) >= 4 and any(w in CORE_LATIN for w in words) and sum(w in LATIN for w in words) * 5 >= len(words) and not any(w in FUNCTION_WORDS for w in words)


def residue_kind(text: str | None) -> str | None:
    """The kind of leftover in ``text``: placeholder, filler, error or scripts; None if there is none.

    Null and empty texts have none.  The first kind in reading order counts.
    """
    if not text:
        return None
    plain = _FENCE.sub(" ", text) if "```" in text or "~~~" in text or "<" in text else text
    low = fold(plain)
    if _repeats(low) and (m := _REPEAT.search(plain)) and not _DNA.match(m.group(1)):
        return "filler"
    tried = {k for k, hints in _IMPLIED.items() if _holds(low, hints)}
    if not tried:
        return None
    if ("noscript" in tried or "html_error" in tried) and _INSIDE.search(_QUOTES.sub(" ", plain)):
        return "scripts" if "noscript" in plain.lower() else "error"
    slots, messages = [k for k in PLACEHOLDERS if k in tried], [k for k in MESSAGES if k in tried]
    for unit in _units(plain):
        low = fold(unit)
        kinds = [k for k in slots if _holds(low, _IMPLIED[k])]
        if kinds:
            quoted = [q.span() for q in _QUOTES.finditer(unit)]
            spans = [(a, b) for _, a, b in _placeholders(unit, kinds) if not any(x <= a and b <= y for x, y in quoted)]
            if spans and not _is_about(unit, spans):
                return "placeholder"
        if "latin" in tried and _holds(low, _IMPLIED["latin"]) and _pseudo_latin([w.lower() for w in _WORD.findall(unit)]):
            return "filler"
        for kind in messages:
            if _holds(low, _IMPLIED[kind]) and (m := _MESSAGE[kind].match(unit)) and not _is_about(unit, [m.span()]):
                return "filler" if kind.startswith("filler") else "scripts" if kind.startswith(("scripts", "noscript")) else "error"
    return None


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds = [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            kind = residue_kind(text)
            if kind:
                ids.append(i)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])


def template_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind`` of the documents that hold a leftover; one pass, no shuffle.

    Null texts give no row; a null id comes out as null.  Every row is looked at
    by itself, so repeated rows come out repeatedly.
    """
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null").mapInArrow(_find, "doc_id long, kind string")
