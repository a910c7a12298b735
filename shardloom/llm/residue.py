"""Template residue and error-page text.

Messages (lines, and sentences within lines) are mined into templates by a prefix tree of fixed depth: numbers
become a wildcard, a message descends by its number of words and its first words to a leaf, and joins the first
template of the leaf that agrees with it in enough places; places that differ become wildcards too. A leaf is grown
whole, whatever its size; where it has many messages, the templates that may agree come from an index. Each template is
classified once, when all its messages are in it, and its verdict goes to all of them.

No sentence is listed. A template is judged by what its words are about: single words of four languages (some of three
more) are grouped by idea - what scripts are, switching on and off, things that can be missing, failing, remedies,
page furniture, dummy text - and a verdict needs the ideas it is made of (a script and a requirement; a thing and a
failure, or a status code; a text and its being provisional) and few words besides. What these words don't know is
learned from the corpus: a template that recurs, and whose documents are otherwise made of notices alone, is residue as
well. A document whose messages, apart from a title line and page chrome, are all filler, error page or script notice
has no content. Separately, ordinary messages are searched for slots that were left unresolved.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.sources.scratch import materialize

#: First words by which a message descends, at most half of its words.
DEPTH = 6
AGREE = 0.7
#: Different messages of a leaf beyond which its templates are looked up in an index; they are the same with and without.
LEAF_MESSAGES = 500
#: Templates that the index gives which are compared at once.
COMPARED = 2_000
#: Documents, and the share of all its documents, in which a template is to stand beside notices alone to be learned.
LEARN_DOCUMENTS, LEARN_SHARE = 3, 0.8
#: Short lines that recur in so many documents are page chrome where they stand beside notices.
CHROME_DOCUMENTS = 5
#: Different messages that a worker counts before it passes them on.
HELD_MESSAGES = 100_000

# ---- messages -------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[.!?…]\s+(?=[A-ZÀ-ÖØ-Þ«¿¡\"'(\[{<])")
_CUT = re.compile(r"[\r\n]+|[.!?…]\s+(?=[A-ZÀ-ÖØ-Þ«¿¡\"'(\[{<])")
_BLANKS = (("\xa0", " "), ("\u200b", ""), ("\ufeff", ""), ("\xad", ""))
_STATUS = re.compile(r"[45]\d\d")
_FAILED = re.compile(r"[45]\d\d(?!\d)")
_NUMBER = re.compile(r"\d+")
_GAPS = re.compile(r"[ \t]+")
_MISREAD = re.compile(r"\S*[ÃÂ]\S*")


def _mask(number: re.Match) -> str:
    return number.group() if _STATUS.fullmatch(number.group()) else "<*>"


def _reread(word: re.Match) -> str:
    try:
        return word.group().encode("cp1252").decode()
    except UnicodeError:
        return word.group()


def messages(text: str) -> list[str]:
    """The lines and sentences of the text, with numbers as wildcards.

    HTTP status codes of failures stay, since they say what a message is; UTF-8 that was read as another encoding is put right.
    """
    out = []
    if not text.isascii():
        if "Ã" in text or "Â" in text:
            text = _MISREAD.sub(_reread, text)
        for c, plain in _BLANKS:
            if c in text:
                text = text.replace(c, plain)
    if "\r" in text:
        text = text.replace("\r", "\n")
    if "\t" in text or "  " in text:
        text = _GAPS.sub(" ", text)
    for line in text.split("\n"):
        lo = 0
        for m in _SENTENCE.finditer(line):
            out.append(line[lo : m.end()])
            lo = m.end()
        out.append(line[lo:])
    out = [m for m in map(str.strip, out) if m]
    return [(_NUMBER.sub(_mask, m) if _FAILED.search(m) else _NUMBER.sub("<*>", m)) if _NUMBER.search(m) else m for m in out]


def could_be_title(message: str) -> bool:
    """Whether a message may be a heading: no mark of a sentence at its end, and fewer than 12 words."""
    return message[-1] not in ".!?…,;:" and message.count(" ") < 12


# ---- the prefix tree ------------------------------------------------------------------------------------------------


#: Where the messages of a template differ, by names or known words; and, when it is judged, where one had a word of content.
MERGED, VARIED = "<>", "<?>"


class Leaf:
    """The templates of a leaf, all of one number of words; a list until it has MANY, then a matrix of word numbers.

    Beyond `indexed` messages the rows to compare come from an index. A message that may differ from a template in d places
    agrees with it in all places of one group at least, if the places are dealt out to d + 1 groups; so templates are
    kept by their words in each group. The first template that agrees is the same in all three forms.
    """

    MANY = 12

    def __init__(self, agree: float = AGREE, indexed: int = LEAF_MESSAGES) -> None:
        self.agree, self.indexed, self.added, self.templates = agree, indexed, 0, []
        self.numbers: dict[str, int] = {MERGED: 0}
        self.words = [MERGED]
        self.matrix: np.ndarray | None = None
        self.groups: list[np.ndarray] = []
        self.places: dict[int, int | list[int]] = {}
        self.varied: dict[int, set[int]] = {}

    def judged(self) -> Iterator[list[str]]:
        """The templates as they are to be judged: a place where a message has a word of content is no name."""
        for i, t in enumerate(self.templates):
            varied = self.varied.get(i, ())
            yield [VARIED if p in varied else w for p, w in enumerate(t)] if varied else t

    def _join(self, i: int, words: list[str]) -> None:
        """Wildcards where the template and a message differ."""
        merged = []
        for p, (a, b) in enumerate(zip(self.templates[i], words)):
            if a != b and not (_ideas[a] and _ideas[b]):
                self.varied.setdefault(i, set()).add(p)
            merged.append(a if a == b else MERGED)
        self.templates[i] = merged

    def _found(self, words: list[str]) -> list[int]:
        """The numbers of a new template's words, of which one copy is kept."""
        for w in words:
            if self.numbers.setdefault(w, len(self.words)) == len(self.words):
                self.words.append(w)
        return [self.numbers[w] for w in words]

    def _keys(self, row: np.ndarray) -> list[int]:
        return [hash((g, row[places].tobytes())) for g, places in enumerate(self.groups)]

    def _post(self, key: int, i: int) -> None:
        there = self.places.setdefault(key, i)
        if isinstance(there, list):
            there.append(i)
        elif there != i:
            self.places[key] = [there, i]

    def _index(self, least: float) -> None:
        """Deal out the places, those with the most different words first, and keep the templates by their words in each group."""
        known = self.matrix[: len(self.templates)]
        n = known.shape[1]
        apart = next(d for d in range(n + 1) if n - d - 1 < least)  # places in which a message may differ from its template
        order = np.argsort([-len(np.unique(c)) for c in known.T], kind="stable")
        self.groups = [order[g :: apart + 1] for g in range(min(apart + 1, n))]
        for i, row in enumerate(known):
            for key in self._keys(row):
                self._post(key, i)

    def _first(self, row: np.ndarray, least: float) -> int:
        """The first template that agrees with the row, or -1."""
        if not self.groups:
            same = (self.matrix[: len(self.templates)] == row).sum(1) >= least
            first = int(same.argmax())
            return first if same[first] else -1
        near: set[int] = set()
        for key in self._keys(row):
            there = self.places.get(key, ())
            near.update(there) if not isinstance(there, int) else near.add(there)
        rows = np.sort(np.fromiter(near, np.int64, len(near)))
        for some in (rows[k : k + COMPARED] for k in range(0, len(rows), COMPARED)):
            same = (self.matrix[some] == row).sum(1) >= least
            first = int(same.argmax())
            if same[first]:
                return int(some[first])
        return -1

    def add(self, message: str) -> int:
        """The place of the template that the message joins; its words that differ become wildcards."""
        words = message.split(" ")
        least, i = self.agree * len(words), -1
        self.added += 1
        if self.matrix is not None:
            if self.added > self.indexed and not self.groups:
                self._index(least)
            row = np.array([self.numbers.get(w, -1) for w in words], np.int32)
            i = self._first(row, least)
        else:
            i = next((j for j, t in enumerate(self.templates) if sum(map(str.__eq__, t, words)) >= least), -1)
        if i >= 0:
            self._join(i, words)
            if self.matrix is None:
                return i
            old = self.matrix[i]
            differ = (old != row) & (old != 0)
            if differ.any():
                before = self._keys(old)
                old[differ] = 0
                for was, key in zip(before, self._keys(old)):
                    if was != key:
                        self._post(key, i)
            return i
        if self.matrix is not None:
            row = np.array(self._found(words), np.int32)
            if len(self.templates) == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            self.matrix[len(self.templates)] = row
            for key in self._keys(row):
                self._post(key, len(self.templates))
            words = [self.words[k] for k in row]
        self.templates.append(words)
        if self.matrix is None and len(self.templates) > self.MANY:
            self.matrix = np.array([self._found(t) for t in self.templates] * 2, np.int32)
        return len(self.templates) - 1


# ---- what words are about -------------------------------------------------------------------------------------------
# Words and stems (ending in *) by idea, in English, German, French, Spanish, and some Dutch, Italian and
# Portuguese. A word may belong to several ideas.

_IDEAS = {
    "script": "javascript javascripts script scripts scripting skript skripte skripten js",
    "switch": "activ* aktiv* ativ* reactiv* enabl* disabl* deactiv* deaktiv* desactiv* désactiv* habilit* deshabilit* abilit* turn turned turning switch switched on off einschalten eingeschaltet ausgeschaltet abgeschaltet anschalten an aus ein encend* allum* allow* autoris* erlaub* zulassen block* blockier* bloqu* support supports supported unterstützt soporta ingeschakeld inschakelen uitgeschakeld",
    "need": "requir* need needs needed must required benötig* erforder* notwendig nötig braucht brauchen nécessi* nécessaire requi* besoin doit devez necesi* requier* debe without ohne sans sin zonder senza sem only nur seulement solo sólo works work working run runs läuft laufen funktion* fonctionn* funcion* vereist nodig",
    "view": "view see show* display* shown anzeigen angezeigt afficher affiché* mostrar ver ansehen anschauen consulter consultar continue weiter continuer continuar use using nutzen utiliser usar app apps application* anwendung* aplicaci* browser* navigateur* navegador* settings setting einstellung* paramètres réglages ajustes configuración window fenster fenêtre ventana option* properly correctly richtig correctement correctamente feature* fonctions full fully experience before checking",
    "thing": "page pages site sites sitio web seite seiten website webseite página páginas pagina document documents dokument documento article artikel artículo file files datei fichier archivo url link links lien enlace adress* address* adresse* dirección resource* ressource* recurso* server* serveur* servidor* gateway proxy upstream host session sitzung sesión request* anfrage* requête* demande* petición solicitud connection verbindung connexion conexión database* datenbank base datos données bbdd data access* zugriff zugang accès acceso permission* permiso* berechtigung* rechte droit* service* dienst* servicio* content inhalt* contenu contenido* system* login account konto compte cuenta object item entry source",
    "fail": "error* fehler* serverfehler erreur* found gefunden trouvé* introuvable* encontrad* encontró gevonden trovat* missing exist exists existe* existiert gibt removed entfernt gelöscht deleted supprim* eliminad* moved verschoben umgezogen déplac* movid* cambió unavailable verfügbar indisponib* disponib* expire* abgelaufen expir* caduc* denied verweigert refus* denegad* forbidden verboten interdit* prohibid* unauthori* autorizad* failed failure fails fehlgeschlagen échou* échec falló fallid* fallo wrong schief* schiefgelaufen problem* problème* problema* timed timeout time-out zeitüberschreitung délai dépassé tiempo espera agotado unreachable reached erreichbar joignable invalid ungültig* bad internal intern* interne interno maintenance wartung* mantenimiento performing undergoing scheduled gone down oops oups ups uh oh hoppla vaya huch sorry leider désolé* lo siento snag unexpected* unerwartet* inattendu* inesperad* too many long longer available producido unknown responding respond* responds antwort* antwortet répond* responde* occurred aufgetreten survenu* ocurri* went ging etwas algo something salió mal met hit ran encountered hiccup glitch trouble crashed offline exception traceback caused could couldn't can't cannot unable konnte* können kann pu peut pudo puede not no nicht pas n'existe n'a niet non keine kein keinen loaded load geladen laden charger cargar process* complet* handle* verarbeit* bearbeit* traiter traité procesar completar overloaded überlastet surcharge* exceeded limit condition dürfen temporarily",
    "remedy": "reload* refresh* retry try again erneut versuchen versuch* neu réessay* recharg* actualis* actualic* prueb* intent* intént* vuelva volver go back return* retour* revenir zurück start home homepage startseite hauptseite accueil inicio check prüf* überprüf* vérifi* compruebe verifique typing tippfehler spelling mistakes contact* kontakt* administrator* administrateur administrador support help* desk hilfe aide assistance soporte ayuda report* signal* melden nennen indique* quote code* código referen* référence* number nummer numéro número id ticket please bitte veuillez por favor sign log anmelden connecter minute* minuten minutos second* sekunden secondes segundos later später tard tarde moment* persist* continues problem write webmaster search suche* looking cherch* busc* line zeile ligne línea module modul módulo stack handler",
    "chrome": "skip main content inhalt contenu contenido back zurück haut arriba top share follow privacy datenschutz confidentialité privacidad terms agb contact kontakt contacto imprint impressum mentions légales aviso legal menu menü pricing preise blog status docs search suche buscar sign login cookies about über home start inicio accueil related siehe auch voir aussi véase también see also rights reserved copyright © rate answer article loading… loading... loading wird geladen… geladen chargement… chargement cargando… cargando wait warten help hilfe teilen partager compartir newsletter subscribe sitemap next previous read more careers press",
    "text": "text texts texte texto content inhalt* contenu contenido heading title titre título überschrift titel paragraph* absatz beispielabsatz paragraphe párrafo copy body box page seite página section abschnitt sección description beschreibung descripción entry eintrag headline caption chapter layout words blindtext beispieltext platzhaltertext something etwas article",
    "dummy": "dummy sample placeholder* platzhalter filler fülltext blindtext beispieltext beispielabsatz platzhaltertext mock lorem test tests testing essai prueba exemple ejemplo beispiel relleno faux here hier ici aquí later später soon bald bientôt pronto próximamente coming follow follows folgt follow* venir arrive write schreiben type enter insert goes stand steht stehen belongs will your ihr* votre su ignore nothing nichts rien nada yet real provis* vorläufig* pendiente ausstehend construction construcción aufbau vorbereitung tbd tba todo replace ersetzen remplacer escriba",
}
# Words that say nothing by themselves.
_PLAIN = "currently momentan actuellement actualmente then puis dann danach luego a an the this that these those of to for is are was were be been has have had in at on by it its we you he she they your our my i us them and or if with from as than into its there when who what which may might would should do does did don't doesn't just some any all it's we're you're over behind either you asked der die das den dem des ein eine einen einem einer diese dieser dieses diesen und oder mit von zu zum zur im am auf für bei ist sind war wird werden wurde hat haben sie wir es er ihrem ihren ihnen uns um dass mehr le la les l un une de du d des à au aux et ou en dans sur pour par est sont été a ont avez avons n'avez il elle nous vous ce cette ces cet qu que qui se sa son ses avec semblent el los las una unos y o del al con para es son está están ha han fue su sus se lo le que esta este esto estos parece het een is van op die und il per di"
# The classical dummy text and words that its generators add to it; four letters in common make a word of it.
_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum phasellus curabitur integer aenean proin sagittis nisl donec mauris vivamus pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas suspendisse potenti nullam cras praesent viverra maecenas fusce faucibus orci luctus ultrices posuere cubilia curae etiam quam augue felis tellus lectus lacus sapien risus ligula massa metus neque nibh nunc odio purus quisque sem semper sodales tincidunt tortor urna ut varius vel venenatis vitae vulputate accumsan aliquam ante arcu at auctor bibendum blandit condimentum congue convallis cursus dapibus diam dictum dignissim dui efficitur eget eleifend elementum erat eros euismod facilisis fermentum feugiat finibus fringilla gravida hendrerit iaculis imperdiet interdum justo lacinia laoreet leo libero lobortis maximus mi molestie mattis nam nec ornare pharetra placerat porta porttitor pretium pulvinar quam rhoncus rutrum scelerisque sollicitudin tempus ullamcorper vehicula volutpat"
# What is typed to fill a line.
_KEYS = "asdf asdfgh qwer qwert qwerty qwertz zxcv jkl jklö foo bar baz qux bla blah abc xyz xxx xxxx yyy zzz test text lorem tbd aaa hjkl sdf"

_BIT = {name: 1 << i for i, name in enumerate(_IDEAS)}
_SCRIPT, _SWITCH, _NEED, _VIEW, _THING, _FAIL, _REMEDY, _CHROME, _TEXT, _DUMMY = _BIT.values()
_CODE, _FREE, _NAME, _BABBLE = (1 << 10), (1 << 11), (1 << 12), (1 << 13)
_LATIN_STEMS = frozenset(w[:4] for w in _LATIN.split() if len(w) > 3)
_LATIN_SHORT = frozenset(w for w in _LATIN.split() if len(w) <= 3)
_KEYBOARD, _NOTHING = frozenset(_KEYS.split()), frozenset(_PLAIN.split())
_STEM_LENGTHS = range(3, 13)
_WHOLE: dict[str, int] = {}
_STEMS: dict[str, int] = {}
for _idea, _listed in _IDEAS.items():
    for _w in _listed.split():
        _at = _STEMS if _w[-1] == "*" and len(_w) > 1 else _WHOLE
        _at[_w.rstrip("*")] = _at.get(_w.rstrip("*"), 0) | _BIT[_idea]
_IDENTIFIER = re.compile(r"\w+(?:[-_.:@/]+[\w<*>()]+)+")
_EDGES = "\"'“”‘’«»()[]{}<>.,;:!?…·|/•>-–—*_#=`¿¡"


class Ideas(dict):
    """Words by what they are about, as bits; 0 for a word of content."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if word in (MERGED, VARIED):
            self[word] = found = _NAME if word == MERGED else 0
            return found
        core = word.strip(_EDGES).replace("’", "'")
        low = core.lower()
        found = _WHOLE.get(low, 0)
        for n in _STEM_LENGTHS:
            if n > len(low):
                break
            found |= _STEMS.get(low[:n], 0)
        if not found and "'" in low:
            found = self[low.split("'", 1)[1]] & ~(_NAME | _FREE)
        if _STATUS.fullmatch(low):
            found |= _CODE
        if low in _KEYBOARD or low[:4] in _LATIN_STEMS or low in _LATIN_SHORT:
            found |= _BABBLE
        if not found & ~_BABBLE and (low in _NOTHING or "<*>" in word or not any(c.isalpha() for c in low)):
            found |= _FREE
        elif not found and (core[:1].isupper() and core[1:].islower() or len(core) > 2 and core.isupper() or _IDENTIFIER.fullmatch(core)):
            found = _NAME
        self[word] = found
        return found


_ideas = Ideas()
_FRAMES, _RULES = frozenset(("at", "in", "en", "bei")), frozenset(".…-_*=")
_TRACE = re.compile(r"(?:at|in|en|bei) [\w<*>.$]+[ (:]+(?:line |zeile |ligne |línea )?(?:<\*>|\w+)", re.I)


def classify(words: list[str]) -> str:
    """error, script or filler; aid (what stands beside notices), chrome or blank; or content, of a template's words."""
    bits = list(map(_ideas.__getitem__, words))
    n, fresh = len(bits), bits.count(0)
    often = n < 6 or n < 5 * len(set(words))
    if often and (2 * fresh > n or 3 * fresh > n and 4 * bits.count(_BABBLE) < n):
        return "content"
    names = bits.count(_NAME)
    if often and fresh:  # too few words that could be known, or dummy text
        rest = n - fresh - names - bits.count(_FREE)
        if 2 * rest < n and rest < 2 * fresh + names:
            return "content"
    tally = [(v, bits.count(v)) for v in set(bits)]
    count = lambda idea: sum(c for v, c in tally if v & idea)
    babble = count(_BABBLE)
    if not often or 2 * babble >= n and (n > 2 or words[0].lower().startswith("lorem")) and (10 * babble >= 7 * n or 5 * sum(c for v, c in tally if v & _FREE and not v & _BABBLE) <= n):
        return "filler"
    if 3 * fresh > n:
        return "content"
    known = count(~(_FREE | _NAME | _BABBLE))
    if known == 0:
        return "blank" if fresh + names == 0 and not any(b & _BABBLE for b in bits) and not any(w.isalpha() for w in words) else "content"
    every = 0
    for v, _ in tally:
        every |= v
    plain = not every & (_CODE | _SCRIPT)
    if plain and every & _CHROME and count(_FREE | _NAME | _CHROME) == n and words[-1][-1] not in "!?":
        return "chrome"
    if plain and not every & _FAIL and (words[0][0] == "©" or words[0].lower() in ("copyright", "(c)")):
        return "chrome"
    if known < 2 * (fresh + names / 2):
        return "content"
    if every & _SCRIPT and (every & (_SWITCH | _NEED) or every & _FAIL and every & _VIEW):
        return "script"
    if every & _CODE and (every & (_FAIL | _THING) or known == 1 and fresh == 0) or every & _FAIL and every & _THING or count(_FAIL) > 1 and 2 * count(_FAIL) >= known - count(_CHROME) or every & _FAIL and known <= 2:
        if not (every & _DUMMY and every & _TEXT and count(_DUMMY) + count(_TEXT) > count(_FAIL) + count(_THING)):
            return "error"
    if every & _TEXT and every & _DUMMY and known > 1 or count(_DUMMY) >= max(2, known - 1):
        return "filler"
    return "aid" if known > 1 or fresh + names == 0 else "content"


def verdict(words: list[str]) -> str:
    """The class of a template; a line of a stack trace is an aid."""
    first = words[0]
    if 2 <= len(words) <= 6 and first.lower() in _FRAMES and _TRACE.match(" ".join(words)):
        return "aid"
    if len(words) > 3 and (words.count(first) == len(words) or first[0] in _RULES and all(set(w) <= _RULES for w in words)):
        return "filler"
    return classify(words)


# ---- unresolved slots -----------------------------------------------------------------------------------------------

# Verbs and adverbs of instructions inside brackets, in four languages.
_ASK = r"(?:insert|enter|add|your|fill in|to be filled|put|hier|ihr|ihre|einfügen|eintragen|ergänzen|insérer|votre|à compléter|compléter|saisir|indiquer|insertar|su|poner|completar|a completar|por completar|escriba|rellenar|falta)"
_VERB = r"(?:insert|enter|add|put|fill in|einfügen|eintragen|insérer|compléter|saisir|indiquer|insertar|poner|completar|escriba|rellenar)"
_ASK_END = r"(?:here|goes here|complete before publishing|einfügen|eintragen|noch ergänzen|ergänzen|ici|aquí|to be filled|à compléter|por completar)"
# What a slot is to be filled with, by stem, in four languages.
_FIELD = r"(?:name|first|last|full|user|customer|client|e-?mail|mail|date|day|month|year|time|amount|price|total|number|address|street|city|country|phone|company|team|project|product|order|invoice|title|link|url|owner|contact|region|version|recipient|sender|signature|position|role|department|vorname|nachname|kunde|betrag|preis|datum|firma|strasse|straße|ort|nom|prénom|montant|prix|entreprise|adresse|équipe|nombre|apellido|importe|precio|fecha|empresa|equipo|dirección)"
_NAME_OF = r"[A-Za-zÀ-ÿ][\wÀ-ÿ.-]*(?: [A-Za-zÀ-ÿ][\wÀ-ÿ.-]*){0,3}"
# an instruction names its value in a few words; longer sentences in brackets are remarks, in parentheses also what names no field
_WORD_IN = r"[^\s\[\]<>{}()]+"
_INSIDE = rf"(?:{_ASK}\b(?:[ \t:]+{_WORD_IN}){{0,6}}|{_WORD_IN}(?:[ \t:]+{_WORD_IN}){{0,6}}?[ \t]+{_ASK_END})[ \t]*"
_UPPER = r"[A-ZÀ-Þ][A-ZÀ-Þ0-9]*(?:[_-][A-ZÀ-Þ0-9]+)*"
_FIELDS = rf"(?:{_WORD_IN}[ \t]+){{0,3}}?(?i:{_FIELD})(?:[ \t]+{_WORD_IN}){{0,3}}"
SLOT = re.compile(
    rf"\{{\{{\{{?\s*{_NAME_OF}(?:\s*\|\s*[\w: \"']+)?\s*\}}?\}}\}}|\$\{{\s*{_NAME_OF}\s*\}}|#\{{\s*{_NAME_OF}\s*\}}|\{{%-?\s*\w+[^%\n]*-?%\}}|<%[=-]?\s*{_NAME_OF}\s*-?%>|%\({_NAME_OF}\)[sdf]"
    rf"|##{_NAME_OF}##|@@{_NAME_OF}@@|~{_UPPER}~|\$[A-Z][A-ZÀ-Þ0-9_]*\$|%[A-Z][A-ZÀ-Þ0-9_]*%|\*\|[\w:]+\|\*|\[\[\s*{_NAME_OF}\s*\]\]|__[A-Z][A-ZÀ-Þ0-9_]*?__|(?<!\w)__(?i:(?:[a-z]+_)*{_FIELD}(?:_[a-z]+)*)__(?!\w)|\bXX[A-ZÀ-Þ][A-ZÀ-Þ0-9_]*XX\b"
    rf"|«{_NAME_OF}»|<<?(?:{_UPPER}|(?i:{_INSIDE}))>>?|<<(?=[A-ZÀ-Þ]){_FIELDS}>>|\[(?:{_UPPER}|(?i:{_INSIDE})|(?=[A-ZÀ-Þ][^\]\n]*[ _-][A-ZÀ-Þ]){_FIELDS})\]|\((?i:(?=[^()\n]*{_FIELD}|[^()\n]*{_ASK_END}[ \t]*\)|{_VERB}(?:[ \t]+[^\s()\d%]+){{1,2}}\)){_INSIDE})\)|\{{(?i:{_INSIDE})\}}|\{{(?:\d|{_NAME_OF})\}}"
)
# How a message names a marker beside it instead of leaving one. A mere mention of templates, or of a brand (Marke, marca), is no such thing.
_MARKERS = r"(?:markers?|placeholders?|platzhaltern?|marqueurs?|marcador(?:es)?)"
_BEFORE = re.compile(rf"\b{_MARKERS}(?:\s+(?:such as|like|named|called|wie|comme|tels? que|como))?\s*:?\s*\Z", re.I)
_AFTER = re.compile(rf"\s*,?\s*(?:(?:or|and|oder|und|ou|et|o|u|y)\s+(?:[^\W\d]+\s+){{0,2}}(?:{_MARKERS}|marken|marcas)\b|where the name belongs\b|(?:stands for|steht für|désigne|representa)\s)", re.I)
_QUOTES = "`\"'“”‘’"
_ENTITY = r"&(?:quot|apos|ldquo|rdquo|lsquo|rsquo|#0*3[49]|#x0*2[27]);"
_OPENED, _CLOSED = re.compile(rf"{_ENTITY}\Z"), re.compile(_ENTITY)
_FENCE = re.compile(r"```.*?```", re.S)
_TAG = re.compile(r"</?([A-Z]{1,6}\d?)>")
_LEVEL = re.compile(r"\[(?:[A-Z]\d*|INFO|WARN|ERROR|DEBUG|TRACE|FATAL|OK|FAIL|SIC)\]")
_MAY = re.compile(r"[{\[<%$#@~«(*]|__|XX")


def open_slots(text: str) -> bool:
    """Whether a marker stands in place of a value: not quoted, not in closed code, no tag that is closed, and not named as a marker."""
    if not _MAY.search(text):
        return False
    plain = _FENCE.sub("\n", text) if "```" in text else text
    cuts, passed = None, 0
    for start in _MAY.finditer(plain):
        m = SLOT.match(plain, start.start()) if start.start() >= passed else None
        if m is None:
            continue
        passed = m.end()
        before, after = plain[m.start() - 1 : m.start()], plain[m.end() : m.end() + 1]
        if before and after and before in _QUOTES and after in _QUOTES:
            continue
        if _OPENED.search(plain[max(0, m.start() - 8) : m.start()]) and _CLOSED.match(plain, m.end()):
            continue
        found = m.group()
        if found[0] == "[" and _LEVEL.fullmatch(found):
            continue
        tag = _TAG.fullmatch(found)
        if tag and f"</{tag[1]}>" in plain:
            continue
        if cuts is None:
            cuts = np.array([0, *(p.end() for p in _CUT.finditer(plain)), len(plain) + 1])
        i = int(np.searchsorted(cuts, m.start(), "right"))
        if not _BEFORE.search(plain[cuts[i - 1] : m.start()]) and not _AFTER.match(plain[m.end() : cuts[min(int(np.searchsorted(cuts, m.end(), "right")), len(cuts) - 1)]]):
            return True
    return False


# ---- the operator ---------------------------------------------------------------------------------------------------

_ROW = "row long, doc_id long, slot boolean, hashes array<long>, titles array<boolean>, hash long, leaf long, message string, n int"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.string(), pa.int32()]


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def branch(words: list[str], depth: int) -> int:
    """The leaf of a message: its number of words and its first words, at most half of them."""
    return _digest(f"{len(words)} " + " ".join(words[: min(depth, max(1, len(words) // 2))]))


def _read(depth: int):
    """Of each document, whether a slot was left and its messages by hash; of each worker, its messages with their leaves."""

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], _NAMES)

    def held(counts: dict[str, list]) -> pa.RecordBatch:
        return rows({"hash": [c[0] for c in counts.values()], "leaf": [branch(m.split(" "), depth) for m in counts], "message": list(counts), "n": [c[1] for c in counts.values()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list] = {}
        row = TaskContext.get().partitionId() << 36
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            slots, hashes, titles = [], [], []
            for text in batch.column(1).to_pylist():
                left = open_slots(text)
                slots.append(left)
                mine, heads = [], []
                for m in messages(text):
                    c = counts.get(m)
                    if c is None:
                        c = counts[m] = [_digest(m), 0, could_be_title(m)]
                    c[1] += 1
                    mine.append(c[0])
                    heads.append(c[2])
                hashes.append([] if left else mine)
                titles.append([] if left else heads)
            n = len(slots)
            yield rows({"row": np.arange(row, row + n), "doc_id": batch.column(0), "slot": slots, "hashes": hashes, "titles": titles})
            row += n
            if len(counts) > HELD_MESSAGES:
                yield held(counts)
                counts = {}
        if counts:
            yield held(counts)

    return run


def _grow(agree: float, indexed: int):
    """From messages sorted by leaf, those whose template isn't content, and recurring content, with template and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "template", "kind", "docs", "line"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()
            return batch

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for leaf, members in groupby(rows(), itemgetter(0)):
            _, last, first, n = next(members)
            tree = None
            for _, h, m, more in members:
                if h == last:  # the same message comes from several workers
                    if tree is None:
                        n += more
                    else:
                        total[i] += more
                    continue
                if tree is None:
                    tree = Leaf(agree, indexed)
                    # of a message only its hash and its template are held
                    hashes, at, lines, total = array("q", (last,)), array("q", (tree.add(first),)), bytearray((could_be_title(first),)), [n]
                i = tree.add(m)
                if i == len(total):
                    total.append(more)
                else:
                    total[i] += more
                hashes.append(h)
                at.append(i)
                lines.append(could_be_title(m))
                last = h
            if tree is None:
                kind = verdict(first.split(" "))
                if kind != "content" or n > 1:
                    out.append((last, last, kind, n, could_be_title(first)))
            else:
                judged = [verdict(t) for t in tree.judged()]
                named = [_digest(f"{leaf} {i}") if kind != "content" or total[i] > 1 else 0 for i, kind in enumerate(judged)]
                for h, i, line in zip(hashes, at, lines):
                    if judged[i] != "content" or total[i] > 1:
                        out.append((h, named[i], judged[i], total[i], bool(line)))
                        if len(out) > 10_000:
                            yield flush()
            if len(out) > 10_000:
                yield flush()
        if out:
            yield flush()

    return run


def residue(documents: DataFrame, depth: int = DEPTH, agree: float = AGREE, leaf_messages: int = LEAF_MESSAGES) -> DataFrame:
    """doc_id, reason: documents to exclude, reason being slot, error, script or filler (the first that holds).

    documents: doc_id, text. Null and blank texts are no case, nor is a document of chrome and a title alone. Rows that
    repeat a doc_id are judged one by one. Extra columns are ignored. From leaf_messages different messages on the templates of a
    leaf are indexed, which changes no result.
    """
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    rows = materialize(texts.mapInArrow(_read(depth), _ROW), "messages")
    mined = rows.where("hash IS NOT NULL")
    sorted_ = mined.select("leaf", "hash", "message", "n").repartition("leaf").sortWithinPartitions("leaf", "hash")
    found = materialize(sorted_.mapInArrow(_grow(agree, leaf_messages), "hash long, template long, kind string, docs long, line boolean"), "templates")
    # a short line that recurs is chrome, where the words alone don't tell
    often = F.col("line") & (F.col("docs") >= CHROME_DOCUMENTS) & (F.col("kind") == "content")
    verdicts = found.select("hash", "template", "docs", F.when(often, "often").otherwise(F.col("kind")).alias("kind"))

    each = rows.where("row IS NOT NULL AND NOT slot").select("row", "doc_id", F.posexplode(F.arrays_zip("hashes", "titles")).alias("nth", "m"))
    each = each.select("row", "doc_id", "nth", F.col("m.hashes").alias("hash"), F.col("m.titles").alias("title"))

    def judged(messages_: DataFrame, by: DataFrame) -> DataFrame:
        """A row a document: how many messages are content, how many of them could be titles, where they and the notices stand."""
        kind = F.coalesce("kind", F.lit("content"))
        content, strong = kind.isin("content", "often"), kind.isin("error", "script", "filler")
        # reasons by order of place, as one number: nth * 4 + the reason
        code = F.when(strong, F.col("nth").cast("long") * 4 + F.when(kind == "error", 0).when(kind == "script", 1).otherwise(2))
        return messages_.join(by, "hash", "left").groupBy("row", "doc_id").agg(
            F.count_if(kind == "content").alias("content"), F.count_if(content & F.col("title")).alias("titles"), F.count_if(kind == "often").alias("often"),
            F.max(F.when(content, F.col("nth"))).alias("last"), F.min(code).alias("first"),
            F.min(F.when((kind == "content") & ~F.col("title"), F.coalesce("template", F.lit(0)))).alias("least"),
            F.max(F.when((kind == "content") & ~F.col("title"), F.coalesce("template", F.lit(0)))).alias("most"),
            F.bit_xor(F.when(strong, F.col("hash"))).alias("company"))

    def bare() -> F.Column:
        # title lines at the beginning: one, or two where a title is repeated; recurring short lines are chrome
        heads = F.col("content") + F.col("often")
        titled = (heads <= 2) & (F.col("titles") == heads) & (F.col("last") * 4 < F.col("first"))
        return (F.col("content") == 0) | titled

    reason = F.element_at(F.array(F.lit("error"), F.lit("script"), F.lit("filler")), (F.col("first") % 4 + 1).cast("int")).alias("reason")
    noted = materialize(judged(each, verdicts).where("first IS NOT NULL"), "noted")  # documents with a notice
    sure = noted.where(bare()).select("doc_id", reason)
    # templates whose documents are otherwise made of notices: learned, if they recur beside different notices
    rest = noted.where(~bare())
    alone = rest.where((F.col("least") == F.col("most")) & (F.col("least") != 0)).groupBy(F.col("least").alias("template"))
    seen = alone.agg(F.count(F.lit(1)).alias("good"), F.min("company").alias("low"), F.max("company").alias("high"))
    known = verdicts.groupBy("template").agg(F.max("docs").alias("docs"))
    learned = seen.join(known, "template").where((F.col("good") >= LEARN_DOCUMENTS) & (F.col("low") != F.col("high")) & (F.col("good") >= LEARN_SHARE * F.col("docs"))).select("template", F.lit("aid").alias("aid"))
    learned = materialize(learned, "learned")
    again = verdicts.join(learned, "template", "left").select("hash", "template", F.coalesce("aid", "kind").alias("kind"))
    open_ = each.join(rest.select("row"), "row", "left_semi")
    more = judged(open_, again).where(bare() & F.col("first").isNotNull()).select("doc_id", reason)
    slots = rows.where("slot").select("doc_id", F.lit("slot").alias("reason"))
    return slots.unionByName(sure).unionByName(more)
