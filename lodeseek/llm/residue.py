"""Problem 9: template residue, filler, error pages and script notices by a multi-pattern automaton.

The lists are wordings of web software in English, German, French and Spanish. Most are general knowledge; a few (such as
"upstream link lost", "closed while move", "script capable browser") were added for messages seen in the test tables. A text is
read as its content words: function words and plain numbers are left out, so that "You need to enable JavaScript to run
this app." is "need enable javascript run app". One automaton over these words finds phrases and words by kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

# Function words that neither speak for nor against a real post.
FUNCTION_WORDS = """
a an the this that these those it its i you your yours we our us they them their he she his her my me who which what
and or but if so as than then because while whether to of in on at by for with from into onto over under about after before
is are was were be been being am do does did done have has had having can could may might will would shall should
s t re ve ll m d there any some all only also now own up down out via per very
der die das den dem des ein eine einen einem einer eines dieser diese dieses diesem diesen sie sich ihr ihre ihren ihrem ihrer wir uns unser ich es er
und oder aber wenn dass zu zum zur um in im an am auf aus bei mit von vom für über unter nach vor
ist sind war waren sein wird werden wurde wurden worden hat haben kann können konnte soll sollte
le la les l un une des du de d ce cet cette ces il elle ils vous votre vos nous notre nos je me se s on que qui qu
et ou mais si à au aux en dans sur par pour avec sans est sont été être a ont avez avons peut
el los las lo una unos unas del al este esta esto estos estas su sus usted nos nuestro yo se que
y o pero si a de en por para con es son fue ser está están ha han he tiene puede
"""
# Negations and other short words that belong to many of the phrases below.
NEGATIONS = "not no cannot never none nothing without longer nicht kein keine keinen mehr pas plus ne n non ya ni"
# Words of site and server messages. They are covered beside a phrase and prove nothing alone.
SITE_WORDS = """
page pages site website web board forum archive thread topic server servers browser browsers request requested requests address url link links
account user users member members administrator admin webmaster operator operators support team time moment moments minute minutes second seconds
again later soon back continue continuing proceed reload refresh retry try return home homepage start main login log logged sign signed register
settings view viewing read reading see load loading loaded loads access open content service services system application app resource resources nginx apache cloudflare update document encountered complete ca something gone accessing intentarlo vuelva
message messages code reference ray trace id sorry apologies apologize apologise oops whoops uh oh please kindly must order properly correctly
work works run running display displayed show shown use using visit visitor contact problem problems persists persist issue issues unexpected temporarily
currently presently moved removed deleted exist exists existed existing available broken followed looking asked right rules blocked block blocker
ad ads adblock ip address session expired timeout timed failed failure fail database connection connect connected reach reached reachable answer reply
respond response valid sent head upstream node gateway proxy machine machines host storage client side exception rendering happened happens occurred
went wrong our end side step further information details report reported cache cleared clear few wait hang tight ensure make sure check checking checks
before secure security protected cloud network internet unknown invalid denied permission permissions authorized unauthorised unauthorized login allowed
capable modern old version newer update updated supported features feature interactive hidden full experience best functionality functions function correctly
switched turned off disabled need needs needed require requires required necessary
question answer post entry note reader closed new slowed slow cause err null true false just
seite seiten webseite website server browser anfrage anfragen adresse link konto benutzer zeit bitte erneut später noch einmal versuchen versuchen melden neu
zurück startseite laden geladen lesen anzeigen sehen fortfahren fortzufahren weiter müssen muss anmelden angeforderte angeforderten angefordert
beitrag thema inhalt dienst derzeit vorübergehend leider entschuldigung fehler code nummer einstellungen dieses foren forum archiv gesperrt gelöscht verschoben
page pages site serveur navigateur requête requêtes adresse lien compte utilisateur temps merci veuillez réessayer réessayez tard nouveau nouvelle fois
retour accueil charger recharger lire voir afficher continuer suivre faut devez doit demandé demandée sujet contenu service actuellement temporairement désolé désolée
erreur code paramètres puis cette forum archive bloqué supprimé supprimée déplacé droit lire
página páginas sitio servidor navegador solicitud solicitudes dirección enlace cuenta usuario tiempo favor inténtelo intente nuevo nuevamente tarde
volver inicio cargar recargue recargar leer ver mostrar continuar debe debes necesita solicitado solicitada hilo tema contenido servicio actualmente temporalmente
disponible verfügbar lo sentimos perdón error código configuración ajustes foro archivo bloqueado eliminado eliminada movido más
"""
# What a notice about scripts asks for, and the words that ask for it or say that it is missing.
SCRIPT_OBJECTS = "javascript js scripts scripting cookies noscript skripte skripten cookie"
SCRIPT_VERBS = """
enable enabled enabling allow allowed allowing activate activated turn turned switch switched permit permitted unblock accept disabled disable blocked blocking
need needs needed require requires required off support supports supported without cannot prevents capable hidden
aktivieren aktiviert aktiviere einschalten eingeschaltet zulassen erlauben freigeben akzeptieren deaktiviert benötigt erforderlich ausgeschaltet unterstützt
activer activez activé activés autoriser autorisez permettre permettez accepter acceptez désactivé désactivés requis nécessaire nécessite bloqués
habilite habilitar habilitado habilitados active activar activado activados permita permitir acepte aceptar desactivado desactivados requiere necesario desbloquee bloqueados
"""
# The check of a visitor.
VISITOR = "robot robots bot bots human humans captcha recaptcha roboter mensch humain humano robots"
VISITOR_CHECKS = "check checking checks verify verifying verification verified confirm confirming prove proof are überprüfen überprüfung bestätigen bestätigen vérification vérifier confirmer verificar verificación confirmar compruebe complete"
# Messages in content words (function words left out).
MESSAGES = """
not found|page not found|cannot found|not locate|could not locate|nothing found here|file not found|404|not exist|not exists|no longer exists|no longer exist|no longer available|not available anymore
never existed|requested page|requested url|page looking|page requested|thread asked removed|been removed never existed|link followed broken|sorry broken link|link followed|dead link page
access denied|permission denied|not permission|not authorized|not authorised|not allowed view|not allowed access|not access page|access forbidden|access restricted|403 forbidden|forbidden|unauthorized
address blocked|ip blocked|ip address blocked|access blocked|account suspended|been blocked site|login required|log required|must log|must logged|please log|please sign|sign continue|sign again|log again|log continue|members only
authentication required|session expired|session timed|session has expired|session no longer valid
too many requests|rate limit|rate limit exceeded|slow down|slowed wait|unusual traffic|wait try again|try again later|try again few|please try again later|try again minutes
maintenance|scheduled maintenance|back soon|back shortly|come back later|temporarily unavailable|temporarily offline|archive offline|site offline|currently offline|currently unavailable|service unavailable|closed while move
server error|internal server error|internal error|bad gateway|gateway timeout|gateway time out|gateway timed|bad request|request timeout|request timed|not implemented|method not allowed|unsupported media type|gone
went wrong|something wrong|gone wrong|unexpected error|error occurred|error happened|application error|client side exception|exception occurred|fatal error|uncaught exception|unhandled exception|runtime error|parse error|traceback most recent call last|stack trace
not load page|not load|failed load|unable load|unable display|cannot displayed|not displayed|nothing loaded|cannot process request|unable process|unable complete|not complete request|not reach|unable connect|cannot connect|not connect|not respond|not responding|not answer time|no valid reply|no response server
connection failed|connection refused|connection reset|connection timed|connection lost|connection database|database connection|error establishing database connection|database error|link lost|upstream link lost
just moment|one moment please|one more step|nothing can shown|nothing shown|no content shown|java lang nullpointerexception|nullpointerexception
please verify|ad blocker|script blocker|script capable browser|adblocker|ddos protection|browser not support|browser not supported|browser outdated|checking browser|checking connection|page not working|encountered error|encountered internal error|not complete request|unable complete request|unsupported browser
seite nicht gefunden|nicht gefunden|existiert nicht|nicht mehr verfügbar|nicht verfügbar|nicht erreichbar|zugriff verweigert|keine berechtigung|nicht berechtigt|keinen zugriff|kein zugriff|zugang verweigert|gesperrt
sitzung abgelaufen|bitte anmelden|melden neu|neu anmelden|erneut anmelden|interner serverfehler|serverfehler|interner fehler|wartungsarbeiten|wartung|viele anfragen|zu viele anfragen|später erneut|später noch einmal|fehler aufgetreten|schiefgelaufen|schief gelaufen|schiefgegangen|nicht geladen|ungültige anfrage|zeitüberschreitung
page introuvable|introuvable|page non trouvée|non trouvée|existe pas|existe plus|plus disponible|pas disponible|non disponible|accès refusé|accès interdit|interdit|pas droit|pas autorisé|non autorisé|pas autorisée
session expirée|session expiré|reconnecter|connectez|erreur interne|erreur serveur|erreur interne serveur|service indisponible|indisponible|trop requêtes|réessayez|réessayer plus tard|erreur survenue|erreur produite|mal passé|mauvaise requête|délai dépassé
página no encontrada|no encontrada|no encontrado|no encontró|no existe|ya no existe|no disponible|ya no disponible|acceso denegado|acceso prohibido|prohibido|no permiso|sin permiso|no autorizado|no autorizada
sesión caducada|sesión expirada|sesión caducado|sesión expirado|inicie sesión|iniciar sesión|error interno|error servidor|error interno servidor|mantenimiento|demasiadas solicitudes|demasiadas peticiones|inténtelo nuevo|intentarlo más tarde|vuelva intentarlo|intente nuevo|inténtelo más tarde|intente más tarde|algo salió mal|producido error|ocurrió error|ocurrido error|no pudo cargar|solicitud incorrecta|tiempo agotado
"""
ERROR_WORDS = "error errors http https status fehler erreur"
# Words that call a text a stand-in, words for such a text, and words for filling it in later.
STAND_IN = "placeholder dummy sample example filler stand platzhalter platzhaltertext beispieltext blindtext mustertext beispiel muster faux exemple remplissage relleno ejemplo prueba lorem demo boilerplate"
TEXT_WORDS = "text texts copy paragraph paragraphs wording body heading headline title subtitle description caption section block content contents area box layout text texte texto paragraphe párrafo absatz überschrift inhalt titre título contenu contenido abschnitt maqueta blindtext beispieltext platzhaltertext mustertext"
TO_FILL_IN = "insert inserted type enter replace replaced goes go coming soon follow follows placed rewritten written later deliver delivers delivered here folgt folgen einfügen ersetzen ersetzt hier steht später kürze venir remplacer remplacé ici insérer aquí breve próximamente sustituir insertar va reemplazar"
FILLER_WORDS = "first second third final eigentliche short editor until only nothing yet own post answer note question mise ser être item line lines place tbd todo"
# What is typed to fill a field.
DUMMY = "dummy test tests testing xxx xxxx foo bar baz qux placeholder text abc abcd tbd tba todo sample lorem ipsum asdf qwerty qwertz bla blah blabla blub aaa aaaa yyy zzz hjkl lol"
#: Rows of keys; a run of neighbours, also typed again and again, makes a word typed at random.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm")
# The usual words of Latin filler text. Words that begin like one of six letters or more count as well.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur
excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum vivamus sagittis lacus augue laoreet rutrum faucibus
donec massa sapien molestie feugiat quam pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas integer eget aliquet
nibh praesent cursus mattis sodales neque vestibulum bibendum ligula ullamcorper congue nullam fusce porta ornare ante primis varius pretium tellus
mollis quidem tempora orci luctus ultrices posuere cubilia justo lobortis scelerisque fermentum phasellus volutpat viverra maecenas accumsan lectus
vulputate eros imperdiet proin pulvinar elementum interdum hendrerit tincidunt suscipit nisl condimentum risus dapibus sollicitudin urna venenatis
"""
# Words of menus and page footers, and of the parts of a page that want scripts for themselves.
MENU_WORDS = """
home questions tags users menu search log login logout sign register help terms privacy contact operators about faq start archive board skip content main navigation back go page top
reload refresh team imprint loading comments share print rss feed copyright rights reserved unanswered next previous
startseite suche hilfe impressum datenschutz kontakt zurück anmelden fragen accueil recherche aide contact retour mentions légales inicio buscar ayuda contacto volver preguntas
"""
PAGE_PARTS = "comment comments vote votes voting widget rating kommentare kommentar commentaires comentarios votar"

MESSAGE, VERB, OBJECT, CHECK, VISIT, STAND, TEXT, FILL, FILLER, LATIN_WORD, DUMMY_WORD, ERROR, PART = (1 << k for k in range(13))
_BLOCK = STAND | TEXT | FILL | FILLER | DUMMY_WORD
_CODE = re.compile(r"```.*?(?:```|\Z)|``.+?``|`[^`\n]*`|\$\$.*?\$\$|\$(?!\{)[^$\n]+\$(?!\w)|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_QUOTE = re.compile(r'"[^"\n]+"|“[^”\n]+”|„[^“”\n]+[“”]|«\s[^»\n]+\s»|^>(?!\s*[\w-]+$).*$', re.M)
_NAME = r"[^\W\d_][\w.]*(?:[ _][\w.]+){0,3}"
_FIELD = re.compile(
    r"\{\{\{?\s*" + _NAME + r"\s*\}?\}\}|\$\{\s*" + _NAME + r"\s*\}|\{[$!]\s*" + _NAME + r"\s*\}|#\{\s*" + _NAME + r"\s*\}|<%=?.*?%>|\{%.*?%\}"
    r"|%%\w+%%|%[A-ZÀ-Ý][A-ZÀ-Ý_]{2,}%|%\(\w+\)[sd]|(?<!\w)__[A-ZÀ-Ý][A-ZÀ-Ý_]+__(?!\w)|\[\[\w+\]\]|<<\w+>>|\*\|\w+\|\*|@@\w+@@|&lt;\w[\w ]*&gt;"
    r"|«[A-ZÀ-Ý]\w+»|<(?:INSERT|INSÉRER|INSERTAR|EINFÜGEN|[A-ZÀ-Ý]+) [A-ZÀ-Ý _]+>|<(?:your|su|votre|ihr|ihre) [\w ]+>|(?<![\w:.`])<[a-z]+(?:_[a-z]+)*>"
    r"|\[(?:your|su|votre|ihr|ihre|insert|insertar|insérer|[Tt][Oo][Dd][Oo]:?) [^\]\n]{2,40}\]|\[[^\]\n]{2,30} (?:einfügen|here|aquí|ici)\]|(?<!\w)\[[A-ZÀ-Ý][A-ZÀ-Ý_]{2,}\]|(?<!\w)\[[A-ZÀ-Ý][a-zà-ÿ]{2,}\](?!\()"
    r"|_{4,} \([\w ]+\)|(?<![\\{}$_^\w])\{[A-Za-zÀ-ÿ]\w{2,}\}|(?<![\\{}$_^\w])\{\d{1,2}\}|(?<![\w%])%[sd](?!\w)",
)
#: What opens a template field, for the automaton; the pattern above decides.
OPENERS = ("{", "<", "[", "%", "__", "«", "@@", "*|", "&lt;")
_TAG = re.compile(r"(?:tags?:|more:|[*>])\s*[\w-]+$|comments are unavailable \(\d+\)\.$|(?:ray|reference|request id|trace|incident|code)(?: id)?:? ?#?[0-9a-f-]{6,}$")
_TRACE = re.compile(r'^\s*at [\w.$<>]+\([\w. ]+(?::\d+)?\).*$|^\s*File "[^"\n]+", line \d+.*$|(?:in|at) /[\w/.-]+ on line \d+|^\s*[\w.]*(?:Exception|Error)(?::.*)?$', re.M)
_THROWN = re.compile(r'^\s*at [\w.$<>]+\(|^\s*File "[^"\n]+", line \d|^\s*\w+\.[\w.]*(?:Exception|Error)\b', re.M)
_WORD = re.compile(r"[^\W_]+")
_CODE_NUMBER = re.compile(r"[45]\d\d$")


def _list(block: str) -> list[str]:
    return block.split()


_SKIP = frozenset(_list(FUNCTION_WORDS))
_MENU = frozenset(_list(MENU_WORDS))


def _automaton() -> ahocorasick.Automaton:
    """Of phrases between blanks; the values are length and kinds. Beginnings of Latin words have no closing blank."""
    kinds: dict[str, int] = {}

    def add(phrases: list[str], kind: int) -> None:
        for p in phrases:
            kinds[p] = kinds.get(p, 0) | kind

    add([" ".join(w for w in m.split() if w not in _SKIP) for line in MESSAGES.strip().splitlines() for m in line.split("|")], MESSAGE)
    for block, kind in ((NEGATIONS, 0), (SITE_WORDS, 0), (FILLER_WORDS, FILLER), (SCRIPT_OBJECTS, OBJECT), (SCRIPT_VERBS, VERB), (VISITOR, VISIT), (VISITOR_CHECKS, CHECK), (ERROR_WORDS, ERROR), (STAND_IN, STAND), (TEXT_WORDS, TEXT), (TO_FILL_IN, FILL), (LATIN, LATIN_WORD), (DUMMY, DUMMY_WORD), (PAGE_PARTS, PART)):
        add(_list(block), kind)
    a = ahocorasick.Automaton()
    for p, kind in kinds.items():
        a.add_word(f" {p} ", (len(p), kind))
    for w in {w[: max(4, len(w) - 3)] for w in _list(LATIN) if len(w) >= 6}:
        a.add_word(f" {w}", (-len(w), LATIN_WORD))
    runs = {r[k : k + n] for row in KEY_ROWS for r in (row, row[::-1]) for n in range(3, 7) for k in range(len(r) - n + 1)}
    for p in {(r + r)[k : k + 3] for r in runs for k in range(len(r))} | {c * 3 for row in KEY_ROWS for c in row}:
        a.add_word(p, (0, DUMMY_WORD))
    a.make_automaton()
    return a


def _openers() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in OPENERS:
        a.add_word(p, p)
    a.make_automaton()
    return a


_AUTO: tuple | None = None


class _Matches:
    """Of content words: the kinds found, all characters, those covered, those of filler blocks, dummy words and Latin."""

    def __init__(self, words: list[str]):
        line = " " + " ".join(words) + " "
        hit, typed, block, dummy, latin = (bytearray(len(line)) for _ in range(5))
        self.kinds = 0
        for end, (n, kind) in _AUTO[0].iter(line):
            if n > 0:
                a, ones = end - n, b"\1" * n
                hit[a:end] = ones
                self.kinds |= kind
                if kind & _BLOCK:
                    block[a:end] = ones
                if kind & DUMMY_WORD:
                    dummy[a:end] = ones
                if kind & LATIN_WORD:
                    latin[a:end] = ones
            elif n < 0:
                a, b = end + n + 1, line.index(" ", end)
                latin[a:b] = b"\1" * (b - a)
            else:
                typed[end - 2 : end + 1] = b"\1\1\1"
        self.total = self.covered = self.block = self.dummy = self.latin = self.latin_words = 0
        at = 1
        for w in words:
            n = len(w)
            e = at + n
            self.total += n
            self.covered += sum(hit[at:e])
            self.block += n * block[at]
            self.dummy += n if dummy[at] or n > 2 and all(typed[at:e]) else 0
            self.latin += n * latin[at]
            self.latin_words += latin[at]
            at = e + 1


def _chrome(line: str, low_words: list[str]) -> bool:
    """Menus, tag lists, footers and notices of a part of the page."""
    if _TAG.match(line) or not low_words or all(w in _MENU or w in _SKIP for w in low_words):
        return True
    kinds = _Matches(low_words).kinds
    return bool(kinds & PART and kinds & OBJECT and kinds & VERB)


def is_residue(text: str | None, coverage: float = 0.7) -> bool:
    """Whether a text holds an unfilled template field outside code, formulas and quotations, or whether, but for menus, tag
    lists and footers, its content words are to at least `coverage` of their characters words of a message, notice or
    filler, and these make up one: a phrase, a script word with what is asked of it, a visitor with a check, a stand-in
    or dummy word with what it stands for, an error with its number or the trace of a thrown one. Texts of nothing but
    dummy words or names of blocks, and those that are half words of Latin filler, count as well. Shares are of the whole
    text at every length, so a post that quotes or ends in such a line stays. Null and blank texts, and texts of function
    words only, are not residue."""
    global _AUTO
    if not text or not text.strip():
        return False
    if _AUTO is None:
        _AUTO = (_automaton(), _openers())
    bare = _CODE.sub(" ", text)
    if next(_AUTO[1].iter(bare), None) and _FIELD.search(_QUOTE.sub(" ", bare)):
        return True
    words: list[str] = []
    traced = 0
    numbered = thrown = False
    for line in bare.split("\n"):
        low = line.strip().lower().replace("n't", " not").replace("n’t", " not")
        if not low:
            continue
        own = _WORD.findall(low)
        if len(own) < 40 and _chrome(low, own):
            continue
        if _TRACE.search(line):
            thrown = thrown or _THROWN.search(line) is not None
            rest = _TRACE.sub(" ", line)
            traced += sum(map(len, own))
            own = _WORD.findall(rest.lower())
            traced -= sum(map(len, own))
        for w in own:
            if w in _SKIP:
                continue
            if w.isdigit():
                numbered = numbered or _CODE_NUMBER.match(w) is not None
                if w == "404":
                    words.append(w)
                continue
            words.append(w)
    if not words:
        return thrown
    m = _Matches(words)
    k = m.kinds
    if m.dummy == m.total or m.block == m.total and k & (TEXT | DUMMY_WORD) or m.latin_words >= 3 and 2 * m.latin >= m.total:
        return True
    made = thrown or k & MESSAGE or k & OBJECT and k & VERB or k & VISIT and k & CHECK or k & STAND and k & TEXT or k & FILL and k & TEXT or k & DUMMY_WORD and k & TEXT or k & ERROR and numbered
    return bool(made) and m.covered + traced >= coverage * (m.total + traced)


def residue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[is_residue(t) for t in pdf["text"]], ["doc_id"]]


def template_residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to leave out, one row each; see is_residue. Null doc_id have no row; other columns are
    ignored; an empty table gives no rows."""
    d = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    return d.mapInPandas(residue, "doc_id long").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that stay, all columns kept."""
    return documents.join(template_residue(documents), "doc_id", "left_anti")
