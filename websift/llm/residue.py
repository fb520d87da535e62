"""Template residue, filler, error pages and notices about scripts in place of content."""

from __future__ import annotations

import re

import numpy as np

# What stands on error pages, by kind; lower case.
ERRORS = [
    # English
    "page not found", "page you asked for", "page you requested", "page you are looking for", "page cannot be found", "was not found", "internal server error", "bad gateway",
    "gateway timeout", "service unavailable", "temporarily unavailable", "upstream request timeout", "upstream server", "too many requests", "has been blocked", "access denied",
    "permission to view", "permission to access", "session has expired", "log in again", "account has been suspended", "something went wrong", "establishing a database connection",
    "fatal error", "allowed memory", "traceback", "most recent call last", "keyerror", "nullpointerexception", "java.lang.", "sqlstate[", "connection refused", "undefined variable",
    "undefined index", "stack trace", "uncaught exception", "segmentation fault", "syntax error", "try again later", "under construction", "domain is for sale", "because of maintenance",
    "down for maintenance", "forbidden", "error 404", "404 -", "403 -", "500 -", "502 -", "503 -", "http error", "could not connect", "did not respond in time", "query failed",
    # French
    "page demandée", "page introuvable", "est introuvable", "n'a pas été trouvée", "n'existe pas", "erreur interne", "passerelle incorrecte", "serveur amont", "n'a pas répondu à temps",
    "accès refusé", "vous n'avez pas les droits", "trop de requêtes", "a été bloquée", "est bloquée", "session a expiré", "reconnectez", "compte a été suspendu", "une erreur s'est produite", "une erreur est survenue",
    "s'est mal passé", "temporairement indisponible", "pour cause de maintenance", "en maintenance", "réessayer plus tard", "réessayez plus tard", "base de données",
    # German
    "seite wurde nicht gefunden", "wurde nicht gefunden", "nicht gefunden", "angeforderte seite", "gewünschte seite", "interner serverfehler", "fehlerhaftes gateway", "nicht rechtzeitig geantwortet", "zugriff verweigert",
    "keine berechtigung", "nicht die rechte", "zu viele anfragen", "wurde gesperrt", "gesperrt", "sitzung ist abgelaufen", "melden sie sich", "konto wurde", "etwas schiefgelaufen", "ist ein fehler aufgetreten",
    "vorübergehend nicht verfügbar", "wegen wartung", "wartungsarbeiten", "versuchen sie es später",
    # Spanish
    "página solicitada", "página no encontrada", "no se encontró", "no se ha encontrado", "error interno", "puerta de enlace", "pasarela incorrecta", "no respondió a tiempo", "acceso denegado", "no tiene permiso",
    "demasiadas peticiones", "demasiadas solicitudes", "queda bloqueada", "ha sido bloqueada", "sesión ha caducado", "sesión ha expirado", "vuelva a entrar", "cuenta ha sido suspendida", "cuenta fue suspendida", "algo ha salido mal",
    "algo salió mal", "no disponible temporalmente", "temporalmente no disponible", "por mantenimiento", "inténtelo más tarde", "vuelva a intentarlo",
    # Italian
    "pagina richiesta", "pagina non trovata", "non è stata trovata", "errore interno", "gateway non valido", "non ha risposto in tempo", "accesso negato", "non ha i permessi", "non dispone dei permessi",
    "troppe richieste", "è stato bloccato", "è bloccato", "sessione è scaduta", "effettui di nuovo", "account è stato sospeso", "qualcosa è andato storto", "temporaneamente non disponibile", "per manutenzione",
    "riprovi più tardi", "riprova più tardi",
    # Dutch
    "gevraagde pagina", "pagina niet gevonden", "niet gevonden", "interne serverfout", "ongeldige gateway", "foute gateway", "antwoordde niet op tijd", "niet op tijd", "toegang geweigerd", "geen toestemming", "geen rechten",
    "te veel verzoeken", "te veel aanvragen", "geblokkeerd", "sessie is verlopen", "log opnieuw in", "meld u opnieuw", "account is opgeschort", "account is geblokkeerd", "er ging iets mis", "er is iets misgegaan",
    "tijdelijk niet beschikbaar", "wegens onderhoud", "probeer het later",
]
# Notices about scripts, cookies and browser checks.
SCRIPTS = [
    "enable javascript", "javascript is disabled", "javascript is required", "requires javascript", "needs scripts", "turn on scripts", "allow scripts", "enable scripts", "turn on javascript", "browser does not accept", "does not support javascript",
    "checking your browser", "before accessing", "verify you are human", "enable cookies", "cookies are disabled", "without scripts",
    "activer javascript", "activez javascript", "besoin de scripts", "autoriser les scripts", "activez-les", "navigateur refuse", "vérification de votre navigateur", "avant l'accès", "sans scripts", "scripts pour utiliser",
    "javascript aktivieren", "aktivieren sie javascript", "braucht skripte", "ohne skripte", "skripte zulassen", "skripte erlauben", "browser nimmt keine", "browser wird vor", "vor dem zugriff", "schalten sie sie",
    "active javascript", "activar javascript", "activa javascript", "necesita scripts", "permitir los scripts", "sin scripts", "actívelos", "navegador no acepta", "comprobando su navegador", "comprobación de su navegador", "verificando su navegador", "antes de acceder",
    "attivi javascript", "attivare javascript", "abilita javascript", "abiliti javascript", "bisogno degli script", "bisogno di script", "permettere gli script", "senza script", "browser non accetta", "verifica del browser", "prima dell'accesso", "li attivi",
    "javascript aan", "javascript in te schakelen", "schakel javascript", "heeft scripts nodig", "scripts toestaan", "zonder scripts", "schakel ze in", "browser accepteert geen", "browser weigert", "browser wordt gecontroleerd", "voor toegang tot",
]
# Filler that editors leave behind.
FILLER = [
    "your text goes here", "your text here", "title of the section", "section title", "click to edit", "insert a short description", "sample paragraph", "replace before publishing", "to be completed", "placeholder text", "enter your text", "add your text", "hello world", "sample page",
    "votre texte ici", "titre de la section", "cliquez pour modifier", "insérez ici", "paragraphe d'exemple", "remplacer avant publication", "à compléter", "texte d'exemple",
    "hier steht ihr text", "ihr text hier", "titel des abschnitts", "überschrift des abschnitts", "abschnittstitel", "zum bearbeiten klicken", "kurze beschreibung der firma", "musterabsatz", "vor der veröffentlichung ersetzen", "zu ergänzen", "beispieltext", "blindtext",
    "su texto aquí", "aquí va su texto", "escriba aquí", "título de la sección", "haga clic para editar", "inserte aquí", "párrafo de muestra", "párrafo de ejemplo", "sustituir antes de publicar", "por completar", "pulse para editar",
    "il suo testo qui", "il tuo testo qui", "qui va il testo", "qui il testo", "titolo della sezione", "fare clic per modificare", "clicca per modificare", "clicchi per modificare", "inserire qui", "inserisca qui", "paragrafo di esempio", "da sostituire prima", "da completare",
    "hier komt uw tekst", "uw tekst hier", "titel van de sectie", "klik om dit blok", "klik om te bewerken", "voeg hier", "voorbeeldalinea", "vervangen voor publicatie", "vervangen vóór", "aan te vullen",
]
# How words of dummy Latin begin, and dummy words.
LATIN = tuple((
    "lorem ipsum dolor sit amet consec conse adipis elit sed eiusm tempor tempus incid labor labr dolore magn aliq enim minim veniam quis nostr exerc ullam nisi commod conseq duis aute irur reprehen volupt velit esse cillu cillo fugi null "
    "pariat except sint occae cupid proid sunt culp offic deser mollit anim varem ctetum"
).split())
DUMMY = {"asdf", "qwer", "qwerty", "test", "testing", "xxx", "xxxx", "foo", "bar", "baz", "blah", "bla", "abc", "tbd", "todo", "dummy"}

#: Placeholders of template languages.
PLACEHOLDER = (
    r"\{\{[^{}]{0,80}\}\}|[$#]\{[^{}]{1,80}\}|<%[^%]{1,80}%>|\{%[^%]{1,80}%\}|\[\[[^\[\]]{1,60}\]\]|%%\w{1,40}%%|__[A-Z][A-Z0-9_]{0,40}__|\*\|[A-Z0-9_:]{1,40}\|\*"
    r"|\{[a-z][\w.]{0,40}\}|\$[a-z][a-z0-9_.]{0,40}\$|\[(?:INSERT|ENTER|YOUR|ADD)\b[^\]]{0,40}\]|@Model\.[\w.]+|<!--.{0,80}?-->|(?:&lt;|<)[a-z][a-z_.]{1,40}(?:&gt;|>)"
)
#: Traces of values that were never set.
UNSET = r"\[object Object\]|\(unset\)|\(null\)|\(undefined\)|\bundefined\b|\bNaN\b|(?:^|[\s|(–-])null(?:$|[\s|).,;:!?–-])|\bN/A N/A\b"
_LEFTOVER = re.compile(f"{PLACEHOLDER}|{UNSET}")
#: A cheap test that every text with a placeholder or an unset value passes.
HINT = r"[{}%$@|<\[]|__|&lt;|undefined|NaN|null|\(unset|N/A"
_WORD = re.compile(r"[^\W\d_]+")
#: Reference numbers on error pages.
_REFERENCE = re.compile(r"^\W*(ref|ray|id|code|error|request|incident)\b[\s:#.]*[\w/ :-]*$", re.IGNORECASE)


def automaton(phrases: list[str]):  # noqa: ANN201
    """A multi-pattern automaton that yields (end, length of the phrase)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def has_leftover(text: str | None) -> bool:
    """Whether a text holds an unfilled placeholder or the trace of an unset value; null and empty texts hold none.

    'undefined' in a reported error ('undefined variable') is no trace of its own.
    """
    if not text:
        return False
    m = _LEFTOVER.search(text)
    return m is not None and not re.search(r"undefined (variable|index|offset|function|method)", text)


def covered(matcher, text: str) -> int:  # noqa: ANN001
    """How many characters of a lower-case text lie in matches; overlaps count once."""
    end, total = 0, 0
    spans = sorted((e - n + 1, e + 1) for e, n in matcher.iter(text))
    for a, b in spans:
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def is_dummy(text: str) -> bool:
    """Whether most words are dummy Latin or dummy words: eight of ten, or one word over and over."""
    words = _WORD.findall(text.lower())
    if len(words) < 2:
        return False
    if sum(w in DUMMY for w in words) >= 0.8 * len(words):
        return True
    latin = sum(w.startswith(LATIN) for w in words)
    return len(words) >= 5 and latin >= 0.75 * len(words)


class Judge:
    """Decides about the lines of a page. One automaton for all phrases of all languages."""

    def __init__(self, coverage: float = 0.6, line_share: float = 0.15) -> None:
        self.coverage, self.line_share = coverage, line_share
        self.matcher = automaton(ERRORS + SCRIPTS + FILLER)

    def line_matches(self, text: str) -> bool:
        """Whether a line is such a message: enough of it is matched phrases, or it is dummy text."""
        clean = " ".join(text.lower().replace("’", "'").split())
        return covered(self.matcher, clean) >= self.line_share * max(len(clean), 1) or is_dummy(text)

    def matches(self, texts) -> np.ndarray:  # noqa: ANN001
        """line_matches for an Arrow array of texts; equal texts are looked at once."""
        lines = texts.dictionary_encode()
        return np.array([self.line_matches(t) for t in lines.dictionary.to_pylist()], bool)[lines.indices.to_numpy()]

    def replaces_content(self, main: list[str], other: list[str]) -> bool:
        """Whether messages and filler make up most of the page's main text. other: lines outside the main body, which count only if they match."""
        hit = total = 0
        for t in main:
            n = len(t.strip())
            match = self.line_matches(t)
            if not match and _REFERENCE.match(t):
                continue
            total += n
            hit += n * match
        for t in other:
            if self.line_matches(t):
                total += len(t.strip())
                hit += len(t.strip())
        return hit > 0 and hit >= self.coverage * total


def array_hint(texts) -> np.ndarray:  # noqa: ANN001
    """For an Arrow array of texts, where HINT is found."""
    import pyarrow.compute as pc

    return np.asarray(pc.match_substring_regex(texts, HINT))
