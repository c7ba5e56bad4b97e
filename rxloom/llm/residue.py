"""Template residue, filler and error pages in texts (problem 10).

Everything is a JVM-side expression over one row: no shuffle, no Python. Three judgements:

* an unfilled placeholder anywhere: one grammar for each kind of delimiter, whose inside must look
  like a field's name; code blocks and the tags of plain markup are taken out first, and sentences
  that explain a placeholder (inline code, wording) are set against those that hold one (density);
* a passage of filler: a run of stand-in words, or a sentence that announces text to come;
* a whole page that is an error message or a notice that scripts, cookies or a human check are
  needed: of what is left after the page's menu and footer are taken away, however long, half the
  sentences or lines must be of that kind (density), so texts that merely speak of errors don't count.

Null, empty and blank texts are no cases. Texts of any length are read whole: all patterns are
bounded or possessive, so that no match needs backtracking over the text. Each grammar is tried only
where the literal that every match of it holds (a delimiter, a word) occurs, which is found first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field's name: an identifier, or up to four plain words.
_FIELD = r"[A-Za-z][\w.\-]{0,40}(?: [\w.\-]{1,30}){0,3}"
_TAG = r"(?!/?(?:p|br|b|i|u|em|strong|div|span|a|ul|ol|li|table|tr|td|th|thead|tbody|h[1-6]|sup|sub|img|hr|body|html|head|title|noscript|script|style|pre|code|section|nav|footer|header|main|small|font|center|blockquote|dl|dt|dd|form|input|button|label|meta|link)\b)"

#: Grammars for each kind of delimiter, by a literal that every match holds.
PLACEHOLDERS = {
    "{": [r"\{\{[^{}]{1,90}\}\}", r"[$#]\{[^{}]{1,60}\}", rf"(?<![\w{{$#%])\{{ ?{_FIELD} ?\}}(?!\}})", r"\{%[^%]{1,90}%\}"],
    "<%": [r"<%[^%]{1,90}%>"],
    "<": [rf"<<\s?{_FIELD}\s?>>", rf"<{_TAG}[A-Za-z][\w.\-]{{0,40}}(?: [\w.\-]{{1,30}})?(?: goes here| here)?>"],
    "&lt;": [rf"&lt;\s?{_FIELD}\s?&gt;"],
    "«": [r"«[A-Za-z][\w.\-]{0,40}(?: [\w.\-]{1,30})?»"],
    "[": [r"\[\[[^\[\]]{1,60}\]\]", r"(?i:\[(?:insert|enter|add|tbd|tbc|todo|fill in|your|placeholder|to be)\b[^\[\]]{0,60}\])", r"\[[A-Za-z]{2,30}(?:[_.][A-Za-z0-9]{1,20}){1,4}\]"],
    "%": [r"(?<!\d)%[A-Za-z][A-Za-z]{1,30}(?:[_.][A-Za-z]{1,20}){0,4}%", r"%\([A-Za-z][\w. ]{0,40}\)[sdfi]"],
    "__": [r"(?<!\w)__[A-Za-z][A-Za-z.]{0,30}(?:[_ ][A-Za-z.]{1,30}){0,4}__(?!\w)", r"_{5,}"],
    "@@": [r"@@[A-Za-z][\w. ]{0,40}@@"],
    "$": [r"\$[A-Za-z][A-Za-z]{1,30}(?:[_.][A-Za-z]{1,20}){0,4}\$"],
    "(": [rf"(?i:\((?:enter|insert|fill in|type|add)(?: the| your)? {_FIELD}\))", r"(?i:\([^()]{0,60}\bto be (?:filled in|filled|completed|inserted|supplied|determined)\b[^()]{0,20}\)?)"],
    "TB": [r"\bTB[DC]:"],
    "TODO:": [r"\bTODO:"],
    "FIXME:": [r"\bFIXME:"],
    "XXXX": [r"\bX{4,}\b"],
}

#: The words of the customary pseudo-Latin filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum ac augue felis justo lectus mauris nisl ornare porta "
    "risus sapien varius vitae vel vestibulum viverra vivamus vulputate urna ultricies ultrices turpis tristique tortor tincidunt tellus suspendisse sollicitudin sodales "
    "semper sem sagittis rutrum rhoncus quisque quam purus pulvinar proin pretium praesent posuere porttitor phasellus pharetra pellentesque orci odio nunc nullam nibh "
    "neque nec nam morbi molestie metus mattis massa malesuada maecenas luctus libero leo laoreet lacus lacinia interdum integer imperdiet iaculis hendrerit habitant "
    "gravida fusce fringilla feugiat faucibus facilisis euismod etiam erat elementum eleifend egestas efficitur eget donec dictum diam dapibus cursus curabitur cras "
    "convallis congue condimentum bibendum auctor at arcu ante aliquet aliquam accumsan blandit a"
).split()

def _trie(words: list[str]) -> str:
    """One expression for all words that reads each letter once, instead of trying word by word."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + _trie(rest) for h, rest in heads.items() if h]
    return f"(?:{'|'.join(parts)})" + "?" * ("" in heads) if parts else ""


#: Stand-in text; each begins at the start of a word.
_STANDS_IN = [
    rf"(?:{_trie(LATIN)}\b[\s.,;:]{{1,4}}){{7}}",
    r"(?:asdf ?){2}|qwerty (?:qwerty|asdf)",
    r"(?:sample|dummy|placeholder|filler|mock|stand-in|specimen) (?:copy|text|paragraph|content|wording|sentence)\b",
    r"stands in for the (?:final|real|actual)\b",
    r"(?:text|copy|wording|content|description|summary|details)(?: for this (?:section|page|part))? (?:to come|to follow|goes here|(?:will|is to) be (?:supplied|added|provided|written|inserted) (?:later|here|soon))\b",
    r"(?:content|text|section) coming soon\b",
    r"replace this (?:paragraph|text|section|sentence|copy)\b",
    r"your (?:heading|title|text|name|logo|headline|content|copy) (?:goes )?here\b",
    r"add (?:a |the |your )?(?:description|text|content|details|summary)\b[^.]{0,40}\b(?:in this box|here)\b",
    r"testing,? testing,? (?:one|1),? (?:two|2)\b",
    r"blind (?:copy|text), |blindtext\b|do not publish\b",
    r"texte de remplacement\b|faux[ -]texte\b|texte (?:à|a) (?:venir|compléter|remplacer)\b|contenu (?:à|a) venir\b",
    r"aqu[ií] va el (?:texto|contenido|título)\b|texto de (?:relleno|ejemplo|prueba)\b|texto (?:definitivo|pendiente)\b|contenido pendiente\b",
    r"platzhalter(?:text)?\b|hier steht (?:der|ein|ihr) text\b|text folgt\b|bitte ersetzen\b|mustertext\b|inhalt folgt\b",
    r"quick brown fox jumps\b",
]

_REPEATED = [r"\b(\w{1,12}+)(?:[ ,]{1,2}+\1\b){4}", r"\b(\w{1,12}+ \w{1,12}+)(?: \1\b){2}"]

#: Sentences that only an error page or a notice begins with.
_NOTICE = [
    r"(?:http )?(?:status|error|fehler|erreur)(?: code| status)? ?:? ?[1-5]\d\d\b",
    r"http(?:/[\d.]+)? ?(?:status ?)?[45]\d\d\b|[45]\d\d (?:[a-z'-]+ ){0,4}[a-z'-]+$|[\w ]{0,60}\b(?:could|can) ?not be (?:located|found) on this (?:server|site)",
    r"(?:sorry|oops|whoops|uh-oh)\b[!.,]|we are sorry, (?:this|the|that|but|we)\b|we(?: ar|')e having trouble",
    r"(?:something|an error|a problem|an unexpected error) (?:went wrong|occurred|has occurred)|unexpected error|unknown error|fatal error",
    r"(?:the |this )?(?:[\w-]+ )?(?:page|file|document|resource|label|url)(?: you (?:requested|want|are looking for))? (?:not found|cannot be found|could not be found|was not found|no longer exists|does not exist|has moved|is unavailable|cannot be displayed)",
    r"the requested (?:\w+ )?(?:resource|page|url|file|label|document)",
    r"(?:access|permission)(?: to this \w+)?(?: is)? (?:denied|forbidden)|forbidden\b|unauthori[sz]ed\b|you (?:do not|don't) have (?:permission|access)|you are not (?:allowed|authori[sz]ed)",
    r"(?:the )?(?:service|server|site|system|website|database)(?: is)?(?: currently| temporarily)? ?(?:unavailable|down for|offline|overloaded|under maintenance|busy)|internal server error|bad gateway|gateway time-?out|request time-?out|bad request",
    r"too many (?:requests|lookups|attempts|connections|queries)|rate limit",
    r"(?:could|can|did) ?not (?:connect|load|reach|open|display|complete)|(?:cannot|can't|unable to|failed to) (?:connect|load|reach|open|display|complete|render|fetch)|connection (?:refused|reset|lost|timed out|to [\w ]{1,40} timed out)|no response from (?:the )?server|the (?:request|connection) (?:has )?timed out",
    r"(?:your |the )?session (?:has )?(?:expired|timed out)|(?:please )?(?:sign|log) in (?:again )?to (?:continue|view|see)",
    r"traceback \(most recent|[\w.$]{3,80}(?:exception|error)\b(?::|$|\s+at\b)|stack ?trace|warning: \w+\(\)|exception in thread|caused by:",
    r"\{ ?\"?(?:error|errors|status|message|code|fault)\"? ?: ?",
    r"(?:please |you need to |you must |veuillez |bitte )?(?:enable|activate|allow|turn on|activer|activez|aktivieren sie|active|habilite)\b[^.]{0,40}\b(?:javascript|js|scripts?|scripting|cookies)\b",
    r"(?:javascript|js|scripts?|scripting|cookies)(?: and (?:javascript|js|scripts?|scripting|cookies))? (?:is|are|must|muss|doit|debe|need|has|have|es|ist|est|seems?|appears?|needs?)(?: \w+){0,3} (?:disabled|off|required|enabled|allowed|necessary|needed|blocked|aktiviert|activé|necesario|turned|erforderlich|requis|deactivated)",
    r"(?:this |the |our )(?:site|page|app|application|website|viewer|portal|archive)(?: \w+){0,2} (?:needs|requires|uses|works only with) (?!no\b)(?:\w+ ){0,3}(?:javascript|scripts|scripting|cookies)",
    r"(?:this|your|the) browser (?:currently |has |is |does |appears ){0,2}(?:blocks?|blocking|disabled|not support|unsupported|outdated|too old)|unsupported browser|browser not supported",
    r"(?:please )?(?:verify|confirm|prove|check)(?: that)? you(?: a|')re (?:a |not a )?(?:human|robot|person|bot)|checking (?:your browser|if the site|that you)|(?:complete|solve) the captcha|i(?: a|')m not a robot|are you (?:a )?(?:human|robot)",
    r"loading ?(?:…|\.\.\.)|if nothing happens",
    r"(?:content|page|label|leaflet) (?:cannot|can not|can't|could not) be (?:displayed|shown|loaded|opened)|you need to enable|<noscript>",
    r"page introuvable|erreur\b[^.]{0,30}(?:serveur|page|chargement)|accès (?:refusé|interdit)|service (?:momentanément )?indisponible|la page (?:demandée|que)",
    r"error al (?:cargar|abrir|conectar)|página no (?:encontrada|disponible)|acceso denegado|no se (?:pudo|puede) (?:cargar|mostrar|abrir|encontrar)|servicio no disponible|la página (?:solicitada|que)|(?:active|habilite) (?:este|el) (?:sitio|navegador)",
    r"die (?:angeforderte )?seite (?:wurde nicht|konnte nicht|existiert|ist nicht)|zugriff verweigert|seite nicht gefunden|(?:der )?(?:dienst|server) (?:ist )?(?:derzeit |vorübergehend )?nicht (?:verfügbar|erreichbar)|fehler beim laden|javascript aktivieren",
]

#: Any text with such a sentence or a stack trace holds one of these at the start of a word, or a match of _HINT.
_HINTS = (
    "status|fehler|erreur|http|on this s|sorry|oops|whoops|uh-oh|having trouble|went wrong|something occurred|something has occurred|problem occurred|problem has occurred|unexpected|not found|not be found|not be located|"
    "no longer exists|does not exist|has moved|unavailable|be displayed|the requested|denied|forbidden|unauthori|permission|not allowed|not authori|down for|offline|overloaded|under maintenance|busy|bad gateway|gateway time|"
    "request time|bad request|too many|rate limit|can't |unable to|failed to|connection|no response|timed out|session|sign in|log in|traceback|stack trace|stacktrace|warning: |caused by|javascript|cookie|browser|"
    "verify you|confirm you|prove you|check you|verify that you|confirm that you|prove that you|check that you|are you human|are you a |are you robot|checking |captcha|robot|loading|nothing happens|be shown|be loaded|be opened|"
    "to enable|noscript|introuvable|refusé|interdit|indisponible|la page|no encontrada|no disponible|denegado|no se pudo |no se puede |la página|active este|active el |habilite |seite|verweigert|verfügbar|erreichbar|during handling"
).split("|")
_HINT = (
    rf"\b(?:{_trie(_HINTS)}|(?:(?:can|could|did) ?)?not ?(?:connect|load|reach|open|display|complete|render|fetch)|(?:js|scripts?|scripting)\b)|error|exception|\{{|\.\.\. \d+ more|"
    r"(?:^|[.!?…;:]\s|[\r\n])[^\w{<]{0,6}[45]\d\d [a-z'-]|(?m:^)\s*at [\w.$<>/]{1,200}\("
)

#: Sentences that go with an error page, but could stand elsewhere.
_ALONG = [
    r"please (?:go back|try|reload|contact|return|wait|refresh|check|come back|sign|log)", r"try (?:again|once more)|go back", r"return to the|contact the (?:site|system|administrator|webmaster|help)",
    r"wait \d+ (?:second|minute)", r"request id|incident|reference|error id|trace id|type status|message /|description the|(?:ref|code)\b", r"our team has been", r"(?:[\w-]+ ){0,3}(?:will )?resumes? (?:at|on|in|soon|shortly)\b|(?:we|it) (?:will|should) be back|back (?:soon|at)",
    r"(?:turn|switch) (?:it|them) on", r"(?:change|check) (?:the|your) (?:settings|connection|spelling|address|url)", r"reload", r"sign in again|log in again", r"file \"|\w+ = |\w+error\b|at [\w.$]+\(", r"la notice|die |le |la |el |por favor|veuillez|bitte|vuelva|retour|zurück",
]

#: Lines of a page around its content.
_CHROME = (
    r"(?im)^[ \t]*(?:[^\n|]{1,30}+(?:\|[^\n|]{1,30}+)++|[^\n>.]{1,40}+(?:(?<= )> [^\n>.]{1,40}+)++|={2,}[^\n]{0,60}={2,}|-{2,}[^\n]{0,60}-{2,}|(?:©|\(c\)|copyright)[^\n]{0,80}|back to (?:top|home|start)|"
    r"(?:menu|home|search|log ?in|sign in|skip to content|contact|terms(?: of use)?|privacy|accessibility|about|help)(?:[ \t]{1,4}(?:menu|home|search|log ?in|sign in|contact|terms(?: of use)?|privacy|accessibility|about|help|labels|recalls))*+)[ \t]*\r?$"
)
#: Code blocks of any length; an unclosed fence or <pre> goes to the end, an unclosed <code> to the end of its line.
_CODE = (
    r"(?s)```(?:(?!```).)*+```|(?m:^)[ \t]{0,3}(?:```|~~~)(?:(?!```|~~~).)*+(?:```|~~~|\z)|<pre\b(?:(?!</pre>).)*+(?:</pre>|\z)|<code\b(?:(?!</code>).)*+</code>|<code\b[^\r\n]*+"
)
_INLINE = r"(`{1,2})(?!`)[^`]++\1"
#: Wording around a placeholder that explains it: certain, or a word for placeholders with one that defines.
_EXPLAINS = (
    r"(?i)\b(?:(?:is|are|gets?) (?:then |later |always |automatically )?(?:replaced|substituted|expanded|interpolated)\b|stands? for\b|expands? (?:in)?to\b|"
    r"(?:shell|bash|batch|build) scripts?\b|command line\b|environment variables?\b|config(?:uration)? files?\b|source code\b)"
)
#: Wording by which a text says that it teaches how to write templates.
_TUTORIAL = r"(?i)\btutorials?\b|\btemplate (?:guides?|documentation|reference|manual)\b|\bhow to (?:use|write|fill|create|define)(?: in)?(?: an?| the| your)?(?: [\w-]{1,20})? (?:templates?|placeholders?|merge fields?|merge tags?|variables?)\b"
_SPEAKS_OF = r"(?i)\b(?:placeholders?|template (?:syntax|variables?|fields?|engines?|languages?)|merge (?:fields?|tags?)|variables?|syntax|braces|delimiters?)\b"
_DEFINES = r"(?i)\b(?:means?|denotes?|for example|e\.g|such as|like|looks?|(?:is|are) (?:called|written|named|marked|used))\b"
_MARKUP = r"(?i)</?(?:p|br|div|span|noscript|b|i|em|strong|h[1-6]|html|body|head|title|center)\s?/?>"
_LINK = r"[.!?…;:]+\s+|\s*[\r\n]+\s*"
#: Lines of a stack trace; one that names a file brings a line of code along.
_TRACE = r"(?i)^\s*(?:at [\w.$<>/]{1,200}\(|traceback \(most recent|caused by:|\.\.\. \d+ more|exception in thread|during handling of the above|[\w.$]{0,80}(?:exception|error)\b(?::|\s*$))"
_FILE = r"(?i)^\s*file \"[^\"\n]{1,300}\", line \d"


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _holds_any(text: Column, literals) -> Column:
    held = F.lit(False)
    for x in literals:
        held = held | text.contains(x)
    return held


def _has_placeholder(text: Column) -> Column:
    held = F.lit(False)
    for literal, grammars in PLACEHOLDERS.items():
        held = held | (text.contains(literal) & text.rlike(_any(grammars)))
    return held


def placeholder(text: Column) -> Column:
    """Whether an unfilled placeholder stands anywhere outside code, unless the text explains placeholders.

    A sentence's placeholder is explained if it stands in inline code, among wording that explains it, or
    in a text that says it teaches templates. A text is no case where sentences that explain outnumber
    the others by more than two to one.
    """
    any_of = _any([g for grammars in PLACEHOLDERS.values() for g in grammars])
    told = F.when(_holds_any(text, ("```", "~~~", "<pre", "<code")), F.regexp_replace(text, _CODE, " ")).otherwise(text)
    sentences = F.filter(F.split(told, r"(?<=[.!?])\s+|[\r\n]+"), _has_placeholder)
    around = lambda s: F.regexp_replace(s, any_of, " ")
    explains = lambda s: ~F.regexp_replace(s, _INLINE, " ").rlike(any_of) | around(s).rlike(_EXPLAINS) | (around(s).rlike(_SPEAKS_OF) & around(s).rlike(_DEFINES))
    explained = F.when(text.rlike(_TUTORIAL), F.size(sentences)).otherwise(F.size(F.filter(sentences, explains)))
    return F.when(_has_placeholder(text), F.when(_has_placeholder(told), explained <= 2 * (F.size(sentences) - explained))).otherwise(False)


def filler(low: Column) -> Column:
    """Whether a text (in lower case) holds a passage of stand-in text."""
    held = low.rlike(r"\b(?:" + _any(_STANDS_IN) + ")")
    for p in _REPEATED:
        held = held | low.rlike(p)
    return held


def page_core(text: Column) -> Column:
    """The text without the lines of a page's menu and footer."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _CHROME, ""), r"(?s)^\s+|\s+$", ""))


def error_page(text: Column, low: Column) -> Column:
    """Whether the whole text (low: in lower case) is an error page or a notice that scripts or checks are needed."""
    core = page_core(text)
    bare = F.regexp_replace(core, _MARKUP, " ")
    sentences = F.filter(F.transform(F.split(bare, _LINK), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 1)
    begins = lambda ps: "(?U)^[^\\w{<]{0,6}(?:" + _any(ps) + ")"
    kinds = F.transform(sentences, lambda s: F.when(s.rlike(begins(_NOTICE)), 2).when(s.rlike(begins(_ALONG)), 1).otherwise(0))
    lines = F.transform(F.filter(F.split(core, r"[\r\n]+"), lambda s: F.length(F.trim(s)) > 0), lambda s: F.when(s.rlike(_TRACE), 1).when(s.rlike(_FILE), 2).otherwise(0))
    judged = F.transform(F.array(F.struct(core.alias("core"), kinds.alias("kinds"), lines.alias("lines"))), lambda p: (F.length(p["core"]) > 0) & (
        (F.array_contains(p["kinds"], 2) & (F.size(F.filter(p["kinds"], lambda k: k > 0)) * 2 >= F.size(p["kinds"])))
        | (F.array_contains(p["lines"], 1) & (F.aggregate(p["lines"], F.lit(0), lambda n, k: n + k) * 2 >= F.size(p["lines"])))
        | p["core"].rlike(r"(?is)^<noscript>(?:(?!</noscript>).)*+</noscript>$") | F.lower(p["core"]).rlike("^\\{ ?\"error")
    ))
    return F.when(low.rlike(_HINT), judged[0]).otherwise(False)


def find_residue(docs: DataFrame) -> DataFrame:
    """doc_id, placeholder, filler, error_page of documents of which at least one holds.

    Extra columns are ignored. A doc_id that comes twice is judged by each of its rows.
    """
    text = F.col("text")
    low = F.col("low")  # made once, in a projection of its own
    held = docs.select("doc_id", "text", F.lower("text").alias("low")).where(text.isNotNull() & (F.length(F.trim(text)) > 0))
    judged = held.select("doc_id", placeholder(text).alias("placeholder"), filler(low).alias("filler"), error_page(text, low).alias("error_page"))
    return judged.where("placeholder or filler or error_page")
