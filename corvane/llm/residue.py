"""Problem 9: unfilled templates, filler text, error messages and scripts-needed notices in place of content.

Each kind of residue has its own grammar. Placeholders are recognised by their delimiters (``{{x}}``, ``${x}``,
``[INSERT X HERE]`` ...), notices and error messages as sentences of their own, by what they are about and by where they
begin, filler by set phrases, by short phrases repeated over and over, and by long runs of words with Latin endings
without any function word of a living language. What surrounds a match decides whether it counts: code blocks, inline
code, formulas and commands are blanked first; a quoted message within a longer sentence, and a few placeholders in a
sentence that explains template syntax, do not count.

Whole texts are searched. An Aho-Corasick automaton of key strings goes over each text once; a grammar is only tried
where one of its own key strings occurs. Repetition and Latin runs are found on word hashes, without Python loops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.session import ship

# ---- grammars, by kind; each with the key strings (lower case) without which it cannot match

_ID = r"[^\W\d_][\w .-]*?"  # what stands between delimiters: a field's name
#: Nouns that name the field of a form or letter; in square or angle brackets, written like a name, they are places to fill in.
_FIELD = (
    r"(?:(?:first|last|full|family|given|middle|your|our|user|company|client|customer|author|recipient|sender|product|project|contact|job|event|institution|journal|study|team|city|street|start|end|due|birth|insert|add|enter|current|today'?s?)[ _-]?)*"
    r"(?:names?|surname|date|day|month|year|time|title|subject|address|city|country|state|zip ?code|post(?:al)? ?code|e-?mail|phone|telephone|fax|number|amount|price|company|client|customer|recipient|sender|author|position|role|department|"
    r"organi[sz]ation|institution|affiliation|location|venue|link|url|website|signature|reference|topic|keyword|placeholder|vorname|nachname|datum|ort|adresse|anrede|firma|nom|prénom|adresse|ville|date|société|nombre|apellidos?|fecha|ciudad|dirección|empresa)"
)
_JS = r"(?:java ?script|js|(?:client[- ]side )?script(?:s|ing)?)"
_BEGIN = r"(?:^|(?<=[.!?:»”\"])|(?<=[.!?]\s)|(?<=\n))[ \t>*#-]*(?:(?:oops|sorry|hmm|error|warning|notice)\b[!.,:]*\s*)?"
_CODE = r"[45]\d\d"
_REASON = r"(?:bad request|unauthori[sz]ed|forbidden|(?:page |file )?not found|method not allowed|request time-?out|gone|too many requests|internal (?:server )?error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
_THING = r"(?:page|file|document|article|full text|item|record|abstract|chapter|resource|content|url|link|text|paper)s?"
_HOST = r"(?:site|web ?site|service|archive|reader|server|system|application|app|viewer|database|journal|platform|page|repository|library)"

GRAMMARS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "placeholder": [
        (("{{",), rf"\{{\{{\s*{_ID}\s*\}}\}}"),
        (("{%",), r"\{%-?\s*\w[^%\n]*%\}"),
        (("${",), rf"\$\{{\s*{_ID}\s*\}}"),
        (("#{",), rf"#\{{\s*{_ID}\s*\}}"),
        (("{",), r"(?<![\\{\w$#^_%}])\{[^\W\d_][^\W_]*(?:_\w+)*\w\}(?![}\w^_])"),
        (("<%",), r"<%[=-]?\s*\w[^%\n]*%>"),
        (("%",), r"(?<![\w%])%{1,2}[A-Za-z][A-Za-z]+(?:_\w+)*%{1,2}(?![\w%])"),
        (("[[",), rf"\[\[\s*{_ID}\s*\]\]"),
        (("<<",), rf"<<\s*{_ID}\s*>>"),
        (("@@",), rf"@@\s*{_ID}\s*@@"),
        (("$$",), r"\$\$[A-Za-z]\w{2,}\$\$"),
        (("__",), r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)"),
        (("«",), r"«[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*»"),
        (("[insert", "[todo", "[tbd", "[tba", "[fill", "[add ", "[your", "[enter", "[placeholder"), r"(?i)\[(?:insert|todo|tb[da]|fill|add|your|enter|placeholder)\b[^\]\n]*\]"),
        (("to be added", "to be inserted", "to be completed", "to come]", "to follow]"), r"(?i)[\[(<][^\])>\n]+ to (?:be (?:added|inserted|completed|filled in|confirmed)|come|follow)[\])>]"),
        (("einfügen", "ergänzen", "eintragen", "einsetzen"), r"(?i)[\[(<][^\])>\n]+ (?:hier )?(?:einfügen|ergänzen|eintragen|einsetzen)[\])>]"),
        (("[insérer", "[insérez", "[inserer", "[ajouter", "[votre", "[à compléter"), r"(?i)\[(?:ins[ée]re[rz]|ajoute[rz]|votre|à compléter)\b[^\]\n]*\]"),
        (("[insertar", "[inserte", "[añadir", "[añada", "[su ", "[complete", "[introduzca"), r"(?i)\[(?:insertar?|inserte|añad[ai]r?|su|complete|introduzca)\b[^\]\n]*\]"),
        (("here>", "here]", "here)", "goes here"), r"(?i)[\[(<](?:!--)?\s*(?:[^\])>\n]+ goes here|(?:your|insert|put|type|add|enter)\b[^\])>\n]+\bhere)\s*(?:--)?[\])>]"),
        (("(enter ", "(insert ", "(fill in", "<enter ", "<insert "), r"(?i)[(<](?:enter|insert|fill in) [^)>\n]{2,}[)>]"),
        (("[", "<"), rf"(?:\[|<)(?=[^\]>\n]*[A-Z_ ])(?i:{_FIELD})(?:\]|>)(?!\()"),
        (("xxx",), r"(?i)\bX{3,} ?\([^)\n]+\b(?:missing|here|tbd|to follow)\) ?X{3,}\b"),
    ],
    "filler": [
        (("lorem",), r"(?i)lorem\s+ipsum\s*[,.;:]?\s*(?:dolor\b|[^\W\d_]{2,}(?:us|um|is|it|et|at|ur|or|em|ant|ent|unt|ont|ibus)\b)"),
        (("lorem",), r"(?i)(?:^|[.!?\n]\s*)lorem\s+ipsum\b(?!\s+(?:text|pages?|passages?|copy|filler|dummy|was|is|has|may|can|or|and|as|in|for|to|does|did)\b)"),
        (("dolor sit amet", "consectetur", "adipisc"), r"(?i)dolor sit amet|consectetur\s+adipisc"),
        (("blind text", "blindtext", "dummy", "filler", "placeholder", "sample text"), rf"(?i){_BEGIN}(?:(?:this|here) is (?:just |only |some )?(?:a )?)?(?:blind ?text|dummy (?:copy|text)|filler (?:copy|text)|placeholder (?:paragraph|text|copy)|sample (?:copy|paragraph))(?:\s*[.!]|\s*$|\s+(?:until|so that|for checking|for the layout|for layout|to be replaced|only|here|goes|stands in|will be replaced))"),
        (("body copy", "goes here", "in this spot", "text goes"), rf"(?i){_BEGIN}(?:body|main|article|running)?\s*(?:copy|text) (?:goes|comes|belongs) (?:in|here|at|on)\b"),
        (("blindtext", "platzhaltertext", "mustertext", "fülltext"), r"(?i)\bdies(?:er|es)? (?:ist|dient) (?:ein|als|nur)\w* (?:blindtext|platzhaltertext|mustertext|fülltext)"),
        (("faux texte", "texte de remplissage", "texte provisoire"), r"(?i)\b(?:ceci est|voici) (?:un |du )?(?:faux texte|texte de remplissage|texte provisoire)"),
        (("texto de relleno", "texto de prueba", "texto provisional"), r"(?i)\b(?:este|esto|éste) es (?:un )?texto (?:de relleno|de prueba|provisional)"),
        (("asdf", "qwert", "qwe rty", "jkl"), r"(?i)\basdf (?:asdf|jkl)|\bqwe(?:rty| rty) (?:uio|asdf|qwe)"),
    ],
    "scripts": [
        (("script", "js"), rf"(?i){_BEGIN}(?:you (?:must|need to|have to|should) |please |kindly |to [^.\n]+, (?:please )?)*(?:enable|activate|allow|permit|turn on|switch on|unblock|re-enable) {_JS}\b"),
        (("script", "js"), rf"(?i)\b(?:please|kindly) (?:enable|activate|allow|turn on|switch on|unblock) {_JS}\b"),
        (("script", "js"), rf"(?i)\b(?:turn|switch) {_JS} on\b"),
        (("script", "js"), rf"(?i){_BEGIN}(?:it (?:seems|looks like|appears) (?:that )?|because |as )?{_JS} (?:is|are|was|were|seems?(?: to be)?|appears?(?: to be)?|must be|has been|have been|needs? to be) (?:currently )?(?:disabled|turned off|switched off|off|blocked|inactive|not (?:detected|enabled|available|supported|active|running)|required|needed|enabled|turned on|switched on)\b"),
        (("script", "js"), rf"(?i){_BEGIN}(?:this|the|our|that) (?:web ?|online )?(?:{_HOST}|article|content|figures?|{_THING}) (?:needs?|requires?|depends? on|relies on|does not work without|will not work without|cannot (?:work|run|load|be shown) without|only works? with) {_JS}\b"),
        (("script", "js"), rf"(?i)\byour browser (?:does not (?:support|run|allow|execute)|refuses|blocks|has (?:blocked|disabled)|cannot run|is blocking|will not run) {_JS}\b"),
        (("script",), rf"(?i){_BEGIN}(?:<noscript>\s*)?(?:nothing to show without {_JS}|{_JS} (?:are|is) (?:needed|required) (?:for|to))\b"),
        (("<noscript",), r"(?i)<noscript\b"),
        (("script",), r"(?i)\b(?:activez|activer|autorisez|autoriser|permettre) (?:java ?script|les scripts)\b|\bjava ?script (?:est désactivé|doit être activé|est nécessaire)"),
        (("script",), r"(?i)\b(?:active|activa|activar|permita|permitir|habilite|habilitar|autorice) (?:java ?script|los scripts)\b|\bjava ?script (?:está (?:desactivado|deshabilitado)|es necesario)"),
        (("script", "skript"), r"(?i)\b(?:aktivieren|erlauben|schalten|zulassen|gestatten) sie (?:bitte )?(?:java ?script|(?:die )?s[ck]ripte)\b|\bjava ?script (?:ist (?:deaktiviert|nicht aktiviert|ausgeschaltet|erforderlich)|muss aktiviert)"),
        (("script",), r"(?i)\b(?:abilita|abilitare|attiva|attivare|habilite|ative|ativar|schakel|zet) (?:java ?script|gli script|os scripts)\b"),
    ],
    "error": [
        (("not found", "forbidden", "unauthori", "gateway", "unavailable", "internal", "too many requests", "gone", "bad request", "request time"), rf"(?i){_BEGIN}(?:http|status|error|code)?[ /.:#\d]{{0,6}}(?:error|status|code)?[ :#]*\b{_CODE}\b\s*[-:–—.,(]*\s*{_REASON}\b(?!\s+(?:of|in|by|for|the|and))"),
        (("bad gateway", "gateway time", "service unavailable", "service temporarily", "forbidden", "not found", "internal server", "too many requests", "unauthori", "method not allowed"), rf"(?i)^[\W_]*{_REASON}[\W_]*$"),
        (("error", "fehler", "erreur", "fallo", "http", "status"), rf"(?i){_BEGIN}(?:http|status|error|fehler|erreur|fallo)(?: (?:error|code|status|http))?\s*[:#]?\s*{_CODE}\s*(?:[.:)–—-]|$|\n)"),
        (("error", "fehler", "erreur", "fallo"), rf"(?i)\((?:error|fehler|erreur|fallo)(?: (?:code|http))? {_CODE}\)\s*(?:[.!]|$|\n)"),
        (('"code"', '"status"', '"error"'), rf"(?i)\"(?:code|status|error|errorcode|statuscode)\"\s*:\s*\"?{_CODE}\b"),
        (("<title>",), rf"(?i)<title>[^<]*\b{_CODE}\b"),
        (("traceback",), r"(?i)traceback \(most recent call last\)"),
        (("exception", ".java:"), r"\b[a-z]\w*(?:\.\w+)+(?:Exception|Error)\b|(?:^|\n)\s*at [\w$.<>]+\([\w.]+:\d+\)"),
        (("error:", "exception:"), r"(?:^|\n)\s*(?:[A-Z]\w*(?:Error|Exception)): "),
        (("warning:", "notice:", "fatal"), rf"(?i)(?:^|\n|[.!?]\s)\s*(?:php )?(?:fatal(?: error)?|warning|notice)\s*: (?:undefined |uncaught |call to |out of memory|maximum execution|allowed memory|include|require|cannot |mysql)"),
        (("connection", "upstream", "query"), rf"(?i){_BEGIN}(?:database connection (?:failed|refused|lost)|could not connect to|connection (?:refused|reset|timed out|to the \w+ (?:failed|was lost))|upstream (?:timed out|connect error|request timeout|server))\b"),
        (("you asked for", "you requested", "you are looking for", "you were looking for", "you tried", "you want"), rf"(?i)\b(?:the|that|this) (?:requested )?{_THING} (?:that |which )?you (?:asked for|requested|are looking for|were looking for|tried to (?:open|reach|access)|want(?:ed)?)\b[^.\n]*\b(?:could not|cannot|can ?not|was not|were not|does not|do not|is not|are not|has been|have been|is no longer|no longer|may have|might have|is gone|not found)\b"),
        (("went wrong", "came up", "occurred", "has happened"), rf"(?i){_BEGIN}(?:something went wrong|(?:a|an|some) (?:unexpected |internal |unknown |technical )*(?:problem|fault|error|issue) (?:came up|occurred|has occurred|happened|arose))\s*(?:[.!,]|$|\n|on (?:our|the) (?:side|server|end)|during|while|when|and|with)"),
        (("session", "login", "token", "visit"), rf"(?i)\byour (?:session|login|token|visit|access token|sign-in|subscription) (?:has |was |is )?(?:expired|ended|timed out|run out|no longer valid|invalid)"),
        (("down for", "closed for", "being moved", "out of order", "under maintenance", "unavailable", "offline", "overloaded", "back soon"), rf"(?i){_BEGIN}(?:the|this|our) {_HOST} (?:is|was|has been) (?:currently |temporarily |now |briefly )?(?:down(?: for|\.|\b)|closed for|being (?:moved|updated|upgraded|serviced)|out of order|under maintenance|unavailable|offline|overloaded|not available|in maintenance)"),
        (("will be back", "back shortly", "back soon"), rf"(?i){_BEGIN}(?:we|{_THING}|the {_HOST}|services?) (?:will|shall|should) be (?:back|available again|online again)\b"),
        (("too many requests", "unusual traffic", "checking your browser", "not a robot", "you are human"), rf"(?i){_BEGIN}(?:too many requests (?:came|were|have|from|in)|unusual traffic (?:was|has|from|on)|we (?:are|have been) (?:checking|verifying) (?:your browser|that you)|(?:please )?(?:confirm|verify|prove) (?:that )?you are (?:not a robot|(?:a )?human))\b"),
        (("right to open", "permission", "not allowed to", "licence", "license", "access"), rf"(?i)\b(?:you do not have (?:the right|permission|access|the rights)|your (?:institution|account|subscription|licen[cs]e) (?:has no|is not|does not|lacks))\b[^.\n]*\b(?:open|view|access|read|see|allow|include|cover|licen[cs]e)"),
        (("denied", "not authori", "restricted", "forbidden"), rf"(?i)(?:^|[.!?:]\s|\n)\s*(?:access|permission) (?:is |was )?denied\s*(?:[.!]|$|\n)|(?:^|[.!?:]\s|\n)\s*not authori[sz]ed\s*(?:[.!]|$|\n)|(?:^|\n)\s*forbidden\s*(?:[.!]|$|\n)"),
        (("fail", "cannot", "could not", "unable to", "did not answer", "lost "), rf"(?i){_BEGIN}(?:we|our (?:system|server|service|site)|the (?:system|server|index|database|service|archive|viewer|application)) (?:have |has |had )?(?:failed to|cannot|can ?not|could not|were unable to|was unable to|is unable to|are unable to|did not (?:answer|respond|reply)|lost track of|lost)(?: (?:that|this|the|open|find|load|locate|show|display|reach|fetch|retrieve)| while| when| in time|\.)[^.\n]*"),
        (("cannot be", "could not be"), rf"(?i){_BEGIN}(?:parts of the {_THING}|tables and figures|(?:the|this|that) (?:{_THING}|figures?|tables?|requested {_THING}))(?: and [a-z]+)? (?:cannot|could not|can ?not) be (?:shown|loaded|displayed|opened|rendered|found|located|retrieved)\b"),
        (("nicht gefunden", "nicht verfügbar", "verweigert", "interner", "nicht erreichbar"), r"(?i)\b(?:seite|dokument|artikel|datei|volltext|dienst|server) (?:wurde |ist |konnte )?(?:derzeit |vorübergehend |momentan )?nicht (?:gefunden|verfügbar|erreichbar)|\bzugriff (?:wurde )?verweigert|\binterner (?:server)?fehler"),
        (("introuvable", "indisponible", "accès refusé", "erreur", "n'a pas été trouv", "n’a pas été trouv"), r"(?i)\b(?:page|document|fichier|article|texte)(?: demandée?)? (?:est |semble )?introuvable|\b(?:service|page|document|site)(?: demandée?)? est (?:momentanément |temporairement |actuellement )?indisponible|\baccès (?:est )?refusé|\bune erreur (?:interne |inattendue )?(?:est survenue|s['’]est produite)"),
        (("no se encontró", "no está disponible", "acceso", "error interno", "no se ha encontrado", "ha ocurrido"), r"(?i)\bno se (?:encontró|ha encontrado|pudo encontrar) (?:el|la) (?:documento|página|archivo|artículo|texto|servicio)|\b(?:la|el) (?:página|documento|archivo|artículo|servicio|texto)(?: solicitad[ao])? no (?:está disponible|existe|se encuentra)|\bacceso (?:no permitido|denegado|restringido)\b|\berror interno(?: del servidor)?\b|\bha ocurrido un error\b"),
    ],
}

#: Words that hold sentences together in the languages at hand; text of any length has them.
FUNCTION_WORDS = (
    "the of and a to in is was that it for on with as his they be at by this had not are but from or have an which were there their been has when who will more no if out so what up its about into than them can only other new some could these two may then do any my now such like our over me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still see own work "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir unter gegen vom kann "
    "le la les de des du un une et est en que qui dans pour pas au sur ne se ce il sont avec plus par ou son cette aux ces chez sous nous mais entre sans "
    "el los las y una por con para del lo su al como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está nos durante "
).split()
LATIN_ENDING = re.compile(r"(?:us|um|is|it|et|at|ur|ae|or|em|ant|ent|unt|ont|rnt|ibus|tio|as|ar|are|ere|que|ue)$")
#: (words in a row without a function word, share of them with Latin endings): the shorter the run, the surer it must be
LATIN_RUNS = ((5, 0.8), (14, 0.6))
REPEATS, PERIOD = 4, 6  # copies in a row of a phrase of at most PERIOD words

#: Sentences judged by what they bring together rather than by set phrases: (kind, key strings, patterns that must all occur).
#: A sentence counts if it is short and isn't told about someone's work, see ``_NARRATIVE``.
_SCRIPT = r"\b(?:java ?-?scripts?|js|scripts?|scripting|skripte?|scripts? java)\b"
_WEB = r"\b(?:browser|navigateur|navegador|page|seite|página|web ?site|site|app|application|portal|viewer|reader|content|inhalt|contenu|contenido)\b"
_DOC = r"\b(?:page|site|web ?site|service|server|document|article|file|resource|link|url|content|request|address|portal|download|full text|record|entry|image|app|seite|dokument|artikel|datei|dienst|inhalt|adresse|document|fichier|contenu|adresse|página|documento|archivo|artículo|contenido|enlace|servicio)s?\b"
_GONE = (
    r"\b(?:(?:does|do|did)(?: not|n.t) (?:exist|respond|load|work)|no longer (?:exists?|available|here|valid|works?|supported)|(?:is|are|was|were|be|been|being) (?:currently |temporarily |momentarily |permanently |now |no longer |not )*"
    r"(?:available|unavailable|out of (?:service|order)|down|offline|moved|removed|deleted|disabled|suspended|blocked|expired|broken|unreachable|inaccessible|overloaded|found|loaded|displayed|shown|opened|retrieved|reached|completed|processed)(?: (?:for maintenance|permanently|temporarily))?|"
    r"(?:has|have) (?:been )?(?:moved|removed|deleted|expired|changed|failed|timed out|crashed|gone)|(?:cannot|could not|can.t|couldn.t|unable to|failed to) (?:be )?(?:find|found|load|loaded|display|displayed|show|shown|open|opened|retrieve|retrieved|reach|reached|connect|process|processed|complete|completed|access|accessed)|"
    r"access denied|not permitted|existiert nicht|nicht mehr (?:vorhanden|verfügbar)|nicht (?:gefunden|erreichbar|verfügbar|geladen)|wurde (?:gelöscht|entfernt|verschoben)|n.existe (?:pas|plus)|n.est (?:pas|plus) disponible|a été (?:déplacée?|supprimée?)|introuvable|"
    r"ya no (?:existe|está)|no (?:existe|está disponible|se pudo|se encuentra)|ha sido (?:movid[ao]|eliminad[ao]))\b"
)
_NEGATED = r"\b(?:not|n.t|no longer|unavailable|out of (?:service|order)|down|offline|moved|removed|deleted|disabled|suspended|blocked|expired|broken|unreachable|inaccessible|overloaded|changed|failed|timed out|crashed|gone|cannot|can.t|unable|denied|nicht|gelöscht|entfernt|verschoben|n.|introuvable|déplacée?|supprimée?|ya no|no|movid[ao]|eliminad[ao])\b"
_ADDRESS = r"\b(?:your?|please|sorry|oops|we|this|that|the|bitte|sie|ihre?|diese[rs]?|die|der|das|veuillez|vous|votre|cette?|la|le|por favor|su|esta?|el)\b"
SENTENCES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    (
        "scripts", ("javascript", "java script", "java-script", " script", "skript", " js "),
        (_SCRIPT, _WEB, r"\b(?:must|needs?|needed|requires?|required|necessary|please|enabled?|activated?|allow(?:ed)?|permit|(?:turn|switch)(?:ed)? (?:it |them )?(?:on|off)|disabled|blocked|inactive|not support\w*|not run|without|aktivier\w*|erforderlich|benötigt|activer|activez|nécessaire|active|habilit\w+|necesari[oa]|requiere)\b", _ADDRESS),
    ),
    ("error", ("page", "site", "service", "server", "document", "article", "file", "resource", "link", "url", "content", "request", "portal", "seite", "dokument", "datei", "página", "documento", "archivo", "enlace", "fichier"),
     (rf"^\W*(?:(?:oops|sorry|error|warning|notice|hinweis|fehler|erreur|désolé|lo sentimos|bitte|unfortunately|leider)\b[\W]*)?(?:(?:the|this|that|your|our|die|der|das|diese[rs]?|ihre?|la|le|cette?|el|esta?|we|it looks like|it seems)\b\W*)?(?:(?:requested|web|online|linked|angeforderte|gewünschte|demandée?)\W+)?(?:{_DOC})(?! (?:of|between|for|in|on|to)\b)", _GONE, _NEGATED)),
    ("error", ("unable to", "cannot ", "can't ", "could not ", "failed to", "too many requests", "not responding"),
     (r"^\W*(?:(?:the|this|our|your|we)\b\W*)?(?:(?:server|system|service|site|application|app|browser|database|request|connection)\b\W*)?(?:(?:is|are|was|were)\b\W*)?(?:(?:currently|temporarily|momentarily)\b\W*)?(?:unable to|cannot|can.t|could not|failed to|too many requests|not responding)\b(?:\W*(?:connect|handle|process|complete|load|establish|reach|fetch|retrieve|display)\b.*\b(?:server|request|database|page|connection|host|content|service|site)\w*)?\W*$",)),
    ("filler", ("text", "copy", "wording", "content", "paragraph", "section", "placeholder", "publish", "inhalt", "texte", "contenu", "texto", "contenido"),
     (r"\b(?:text|copy|wording|content|paragraph|section|placeholder|draft|inhalt|texte|contenu|texto|contenido)s?\b", r"\b(?:goes here|to follow|follows?\W*$|to come\b|coming soon|pending|(?:must|should|will|needs? to|has to|to) be (?:written|added|inserted|supplied|completed|replaced|filled in|provided|updated)|replace (?:this|it|me|before|with)|change this|do not publish|under construction|folgt\W*$|wird (?:noch )?(?:ergänzt|nachgereicht)|à venir|à compléter|próximamente|pendiente)\b")),
    ("filler", ("publish", "release", "placeholder"), (r"^\W*(?:do not publish|replace (?:this |it )?before (?:release|publication|publishing)|placeholder\b)", r"^\W*(?:\w+\W+){0,11}\w+\W*$")),
]
SENTENCE_MOST = 24  # words of a sentence that is a notice
_NARRATIVE = re.compile(
    r"(?i)\b(?:study|studies|trial|cohort|patients?|participants?|volunteers?|mice|rats?|cells?|authors?|reviewers?|editors?|users? (?:who|saw|reported|often)|readers? (?:who|saw|reported|often)|when(?:ever)? (?:a|an|the|readers?|users?|visitors?)|if (?:a|an|the)|such|called|says?|said|reads?|wrote|written in|python|perl|bash|shell|r scripts?|github|repository|analysis|analy[sz]ed|manuscripts?|prescri\w+|transcripts?|error (?:message|page)s?|messages? (?:like|such|that)|means?|explains?|describes?|lorem)\b"
)

#: What is code or formula; blanked before any grammar but those of error dumps is tried.
CODE = re.compile(r"```.*?```|<(code|pre)\b.*?</\1>|`[^`\n]+`|\$[^\s${][^$\n]{0,80}\$(?!\$)|\\\w+(?:\{[^{}\n]*\})+|\\begin\{(\w+\*?)\}.*?\\end\{\2\}", re.S | re.I)
TUTORIAL = re.compile(
    r"(?i)\b(?:syntax|templat(?:e|es|ing)|jinja|handlebars|mustache|liquid|velocity|placeholders?|variables?|merge fields?|written as|is replaced (?:by|with)|are replaced (?:by|with)|format string|notation|expands to|macro|printf)\b"
)
#: Everyday words for explaining; they discount a placeholder only in quotation marks.
GENERAL = re.compile(r"(?i)\b(?:for example|e\.g\.|such as|denotes?|stands for|expression|means)\b")
TUTORIAL_MOST = 3  # placeholders that a text may quote for each 1,000 characters, in sentences that explain them
QUOTES = {"“": "”", '"': '"', "‘": "’", "'": "'", "«": "»", "„": "“"}


@lru_cache(maxsize=1)
def _compiled() -> tuple:
    import ahocorasick

    rules = [(kind, re.compile(p, re.M if kind == "error" else 0)) for kind, ps in GRAMMARS.items() for _, p in ps]
    keys: dict[str, set[int]] = {}
    n = 0
    for ps in GRAMMARS.values():
        for strings, _ in ps:
            for s in strings:
                keys.setdefault(s, set()).add(n)
            n += 1
    for _, strings, _ in SENTENCES:
        for s in strings:
            keys.setdefault(s, set()).add(n)
        n += 1
    automaton = ahocorasick.Automaton()
    for s, which in keys.items():
        automaton.add_word(s, frozenset(which))
    automaton.make_automaton()
    function = np.unique(tokens.words_of([" ".join(FUNCTION_WORDS)]).hash)
    return rules, automaton, function


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the match stands in quotation marks within a sentence that says more than the quotation."""
    before = text[max(0, start - 2) : start].strip()[-1:]
    close = QUOTES.get(before)
    if not close:
        return False
    stop = text.find("\n\n", end)
    if text.find(close, end, stop if stop >= 0 else len(text)) < 0:
        return False
    lead = re.split(r"[.!?\n]", text[: start - 1])[-1]
    return len(re.findall(r"\w+", lead)) >= 3


def _sentence(text: str, start: int, end: int) -> str:
    a = max(text.rfind(c, 0, start) for c in (". ", "! ", "? ", "\n"))
    b = min((x for x in (text.find(c, end) for c in (". ", "! ", "? ", "\n")) if x >= 0), default=len(text))
    return text[a + 1 : b]


def judge(text: str | None) -> set[str]:
    """The kinds of residue that ``text`` has by grammar. Null and empty texts have none."""
    if not text:
        return set()
    rules, automaton, _ = _compiled()
    which: set[int] = set()
    for _, hit in automaton.iter(text.lower()):
        which |= hit
    if not which:
        return set()
    bare = CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if ("`" in text or "$" in text or "\\" in text or "<" in text) else text
    out: set[str] = set()
    explained = 0
    for k in sorted(k for k in which if k < len(rules)):
        kind, rule = rules[k]
        if kind in out:
            continue
        for m in rule.finditer(bare):
            if kind == "placeholder":
                around = _sentence(bare, m.start(), m.end())
                if TUTORIAL.search(around.replace(m[0], " ")) or (GENERAL.search(around) and bare[max(0, m.start() - 1) : m.start()] in QUOTES):
                    explained += 1
                    if explained * 1000 <= TUTORIAL_MOST * max(1000, len(text)):
                        continue
            elif kind != "filler" and _quoted(bare, m.start(), m.end()):
                continue
            out.add(kind)
            break
    for kind, sentence in _notices(bare, which - set(range(len(rules)))):
        if kind not in out:
            out.add(kind)
    return out


def _notices(bare: str, which: set[int]) -> Iterator[tuple[str, str]]:
    """(kind, sentence) of the sentences that bring together all that a rule of SENTENCES asks for."""
    if not which:
        return
    low, rules = bare.lower(), _sentence_rules()
    first = len(_compiled()[0])
    which = {k for k in which if all(p.search(low) for p in rules[k - first] if not p.pattern.startswith("^"))}
    if not which:
        return
    keys = re.compile("|".join(re.escape(s.strip()) for k in which for s in SENTENCES[k - first][1]))
    for m in _SENTENCE.finditer(low):
        sentence = m[0]
        if len(sentence) > 40 * SENTENCE_MOST or not keys.search(sentence) or len(_WORDS.findall(sentence)) > SENTENCE_MOST:
            continue
        for k in sorted(which):
            kind, strings, _ = SENTENCES[k - first]
            # what stands in brackets is a place to fill in, not a notice
            own = _BRACKETED.sub(" ", sentence) if kind == "filler" else sentence
            if any(s.strip() in own for s in strings) and all(p.search(own) for p in rules[k - first]) and not _NARRATIVE.search(own):
                if kind == "filler" or not (sentence.strip()[:1] in QUOTES or _quoted(bare, m.start(), m.end())):
                    yield kind, sentence


_SENTENCE = re.compile(r"[^\n]+?(?:(?<=[.!?:])\s+|\n|$)")
_WORDS, _BRACKETED = re.compile(r"\w+"), re.compile(r"[\[<(][^\])>]*[\])>]")


@lru_cache(maxsize=1)
def _sentence_rules() -> list[list[re.Pattern]]:
    return [[re.compile(p) for p in patterns] for _, _, patterns in SENTENCES]


def runs(w: tokens.Words) -> np.ndarray:
    """Which texts of ``w`` hold repeated phrases or Latin runs, as an array of booleans."""
    n = len(w.first) - 1
    found = np.zeros(n, dtype=bool)
    if not len(w.hash):
        return found
    text = np.repeat(np.arange(n), np.diff(w.first))
    letters = w.data[w.start] > 57
    for k in np.flatnonzero(w.end - w.start > 24).tolist():  # sequences of bases or amino acids are no words
        letters[k] &= not w.text(k, k).isupper()
    hashes = np.where(w.data[w.start] > 57, w.hash, np.uint64(1))  # one number is like another
    lettered = np.concatenate([[0], np.cumsum(letters)])
    for p in range(1, PERIOD + 1):
        if len(w.hash) <= p:
            break
        same = (hashes[p:] == hashes[:-p]) & (text[p:] == text[:-p])
        need = max(REPEATS + 1, (REPEATS - 1) * p)
        for a, b in _stretches(same):
            if b - a >= need and 3 * (lettered[b] - lettered[a]) >= 2 * (b - a):
                found[text[a]] = True
    function = _compiled()[2]
    at = np.minimum(np.searchsorted(function, w.hash), len(function) - 1)
    alien = (function[at] != w.hash) & letters
    cuts = np.zeros(len(alien), dtype=bool)
    cuts[1:] = text[1:] != text[:-1]
    for a, b in _stretches(alien, cuts):
        if b - a >= LATIN_RUNS[0][0] and not found[text[a]]:
            ws = re.findall(r"[^\W\d_]+", w.text(a, b - 1).lower())
            share = sum(len(x) > 3 and bool(LATIN_ENDING.search(x)) for x in ws) / max(1, len(ws))
            if len(set(ws)) >= 4 and any(len(ws) >= n and share >= least for n, least in LATIN_RUNS):
                found[text[a]] = True
    return found


def _stretches(flags: np.ndarray, cuts: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of True that are longer than three; ``cuts`` marks where a new run must begin."""
    if not len(flags):
        return
    change = np.flatnonzero(np.concatenate([[True], (flags[1:] != flags[:-1]) | (cuts[1:] if cuts is not None else False), [True]]))
    lo, hi = change[:-1], change[1:]
    keep = flags[lo] & (hi - lo > 3)
    yield from zip(lo[keep].tolist(), hi[keep].tolist(), strict=True)


def classify(array: pa.Array) -> list[set[str]]:
    """The kinds of residue of each text of an Arrow column."""
    out: list[set[str]] = []
    for i, j, w in tokens.pieces(array):
        repeated = runs(w)
        for k, t in enumerate(array.slice(i, j - i).to_pylist()):
            kinds = judge(t)
            if repeated[k]:
                kinds = kinds | {"filler"}
            out.append(kinds)
    return out


def residue(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kinds) of the documents with residue; kinds is a sorted array of placeholder, filler, scripts, error.

    Null and empty texts have none. Rows with equal keys give a row each. Other columns are ignored.
    """
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = classify(batch.column(1))
            at = [k for k, x in enumerate(kinds) if x]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([sorted(kinds[k]) for k in at], pa.list_(pa.string()))], [key, "kinds"])

    rows = documents.where(F.col(key).isNotNull() & (F.length("text") > 0)).select(key, "text")
    return rows.mapInArrow(find, f"`{key}` {kind}, kinds array<string>")


def clean_corpus(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus without residue: an anti-join on the key, so rows without a key and null texts stay."""
    return documents.join(residue(documents, key).select(key).distinct(), key, "left_anti")


def residue_found(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents with residue, each once."""
    return residue(documents).select("doc_id").distinct()
