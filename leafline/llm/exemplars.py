"""Labelled exemplars for :mod:`leafline.llm.residue`, by families.

Fixed values: short phrases from general knowledge of what web servers, page builders, browsers and editors show where
content is missing, in the corpus languages. ``CORE`` phrases mark a family; the words in ``ALONG`` often stand beside
them in such texts and are no evidence by themselves; ``ABOUT`` holds words of texts that speak about such things.
Families with many forms are made by rule: HTTP messages from the standard list of status codes, notices about scripts
from a noun and a verb, filler from the usual blind text.
"""

from __future__ import annotations

import unicodedata
from http import HTTPStatus

STEM, SLOT, NUMBER, LETTER, STATUS = 6, "zzslot", "zznumber", "zzletter", "zzstatus"
SPECIAL = (SLOT, NUMBER, LETTER, STATUS)
STATUS_CODES = [str(s.value) for s in HTTPStatus if s.value >= 400]

LOREM = """lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim veniam quis nostrud exercitation
ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat
cupidatat proident culpa officia deserunt mollit laborum vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas
curabitur vivamus phasellus vulputate sagittis suspendisse""".split()

CORE = {
    "filler": [
        "placeholder", "placeholder text", "sample text", "dummy text", "dummy theme", "example text", "filler text", "text here", "title here", "description here", "content here", "name here",
        "click here", "double click", "your headline", "short summary", "add text", "type text", "text to come", "not yet defined", "nothing to see", "nothing here yet", "insert text", "insert title", "insert description", "insert name", "add description", "add title", "enter text", "enter title", "your text", "your title", "your content", "replace text",
        "tbd", "tba", "todo", "fixme", "tbc", "to be defined", "to be determined", "to be filled", "to be announced", "to be added", "to be completed", "to be written", "coming soon",
        "under construction", "untitled", "no title", "no description", "work in progress", "asdf", "qwerty", "xxx", "foo bar", "blah", "abc 123", "undefined", "null", "nan", "n a",
        "test test", "summary 1", "topic 1", "topic x", "item 1", "keyword 1", "term 1", "heading 1", "label 1", "lorem",
        "platzhalter", "platzhaltertext", "blindtext", "beispieltext", "mustertext", "hier steht", "hier kommt", "titel folgt", "hier eingeben", "überschrift eingeben", "text folgt", "inhalt folgt", "hier einfügen", "text einfügen", "titel einfügen", "ihr text", "ohne titel",
        "folgt in kürze", "demnächst verfügbar", "noch zu ergänzen", "text eingeben", "wird ergänzt", "im aufbau",
        "texte à venir", "texte d'exemple", "votre texte", "votre titre", "texte de remplissage", "faux texte", "texte ici", "titre ici", "à compléter", "à définir", "à remplir", "bientôt disponible", "sans titre", "insérer texte",
        "exemple de texte", "remplacez texte", "en construction", "contenu à venir",
        "texto de relleno", "texto pendiente", "su texto", "texto aquí", "título aquí", "escriba aquí", "título va aquí", "texto de ejemplo", "próximamente", "por definir", "por completar", "sin título", "inserte texto", "insertar texto",
        "reemplace texto", "en construcción", "pendiente de completar",
    ],
    "error": [
        "page not found", "file not found", "nothing was found", "page can't be found", "have been blocked", "back shortly", "domain is for sale", "page expired", "request failed", "link broken", "link you followed", "not responding", "didn't respond", "not found", "page not exist", "doesn't exist", "page could not be found", "can't find page", "cannot find page", "page isn't available", "page unavailable",
        "can't be reached", "cannot be reached", "cannot be displayed", "something went wrong", "went wrong", "error occurred", "unexpected error", "unknown error", "access denied", "permission denied",
        "permission to view", "permission to access", "not authorized", "session expired", "session timed out", "sign in again", "log in again", "timed out", "timeout error", "connection refused",
        "connection reset", "connection lost", "connection closed", "try again", "try again later", "down for maintenance", "under maintenance", "scheduled maintenance back", "no healthy upstream",
        "upstream connect error", "unexpected end of response", "limit exceeded", "quota exceeded", "trouble finding", "connection not private", "currently unavailable", "content unavailable", "no longer available", "no longer exists", "service unavailable", "temporarily unavailable", "temporarily down", "server error",
        "error in application", "internal error", "fatal error", "unhandled exception", "database error", "failed to load", "could not load", "failed to fetch", "invalid request", "link expired", "page moved",
        "forbidden", "unauthorized", "gone", "error status", "http status", "error code", "account suspended", "domain parked",
        "seite nicht gefunden", "nicht gefunden", "seite existiert nicht", "zugriff verweigert", "zugriff gesperrt", "kein zugriff", "keine berechtigung", "etwas schiefgelaufen", "ist schiefgelaufen", "serverfehler", "interner fehler", "fehler aufgetreten",
        "schiefgelaufen", "schief gelaufen", "dienst nicht verfügbar", "seite nicht verfügbar", "derzeit nicht verfügbar", "nicht erreichbar", "antwortet nicht", "sitzung abgelaufen", "zeitüberschreitung", "verbindung abgelehnt",
        "zu viele anfragen", "wartungsarbeiten", "fehler status", "versuchen später erneut", "anfrage fehlgeschlagen", "kann nicht angezeigt",
        "page introuvable", "introuvable", "page n'existe pas", "page non trouvée", "n'avez pas accès", "pas autorisé", "accès refusé", "accès interdit", "accès non autorisé", "erreur survenue", "erreur est survenue", "erreur produite",
        "erreur interne", "erreur serveur", "service indisponible", "temporairement indisponible", "page indisponible", "session expirée", "ne répond pas", "session expiré", "délai dépassé", "trop de requêtes", "en maintenance",
        "connexion refusée", "mauvaise passerelle", "erreur status", "veuillez réessayer", "réessayez plus tard", "impossible d'afficher",
        "página no encontrada", "no encontrada", "no encontrado", "página no existe", "acceso denegado", "acceso prohibido", "acceso restringido", "error interno", "ocurrido error", "producido error", "algo salió mal", "salido mal", "no tiene permiso", "sin permiso",
        "servicio no disponible", "no responde", "página no disponible", "temporalmente no disponible", "sesión caducado", "sesión expirado", "sesión caducada", "tiempo agotado", "demasiadas solicitudes",
        "demasiadas peticiones", "en mantenimiento", "conexión rechazada", "error servidor", "inténtelo de nuevo", "intente nuevamente", "no se puede mostrar",
    ],
    "script": [
        "noscript", "you are human", "not a robot", "checking your browser", "enable cookies", "cookies disabled", "eres humano", "êtes humain", "sie ein mensch", "prüfen browser", "cookies aktivieren", "activer cookies",
        "activar cookies", "habilite cookies", "vérification navigateur", "comprobando navegador",
    ],
}

#: Nouns and, as stems, verbs of notices that scripts must be on.
SCRIPTS = ["javascript", "js", "scripts", "skripte"]
SCRIPT_VERBS = """enable enabled enabling disable disabled require required requires need needed needs turn switch switched activate activated allow allowed blocked blocking unblock block must support run without off
aktivieren aktiviert aktiviertes aktivierung deaktiviert einschalten eingeschaltet schalten benötigt benötigen erfordert erforderlich ausgeschaltet erlauben zulassen unterstützt ohne
activer activez activé désactivé requis requiert nécessaire nécessite besoin autoriser autorisez bloqué sans exécute
active activar activado habilite habilitar habilitado desactivado deshabilitado requiere requerido necesita necesario permita permitir bloqueado sin ejecuta""".split()

ALONG = {
    "filler": """text texts title titles heading name names description content contents summary theme topic item term keyword section page document cluster node label field goes go here your own the a an this that with
write written short summary headline insert enter add replace new later soon be to is will available more info information of for in and click edit body paragraph subtitle caption value example sample here's number one two
ihr ihre ihren eigenen der die das den diesen dieser durch hier titel überschrift beschreibung thema inhalt bitte ersetzen noch folgt später eintragen name stichwort abschnitt ein eine und zu
votre vos texte titre thème contenu nom description sujet le la les un une de du ce cet par ici plus tard venir et à en section résumé
su sus texto título tema contenido nombre descripción asunto el los las una por este esta aquí más tarde y en sección resumen part sit sed do ut et ad ex non""".split(),
    "error": """error oops sorry uh oh page pages site website web http https status code requested request url server resource address link looking for this that the we you your our it is was has have been be are not no
try again later please refresh reload retry contact administrator support id reference ref number seconds minutes in on to from of at by a an and or if does do doesn't exist exists moved deleted removed renamed right now
temporarily currently back home homepage soon app application before headers disconnect gateway response end content data loading network while processing your login sign signed out view access permission
the requested could found be browser unexpected occurred unable complete whoops location shortly something wrong refresh again expired failed with followed broken having trouble we're content private secure hmm
fehler leider hoppla ups etwas unerwarteter unerwarteten unbekannter seite seiten ist ein eine einer der die das den es nicht wurde wird zurzeit derzeit bitte versuchen sie später erneut noch einmal angeforderte angefragte server adresse zur startseite status kann konnte auf
erreur désolé oups accéder page la le les cette ce une un est a n'est pas été demandée demandé veuillez réessayer plus tard serveur adresse vers accueil votre vous de du statut
error lo sentimos acceder algo página la el los las esta este una un es no ha se fue solicitada solicitado por favor inténtelo intente más tarde nuevo servidor dirección volver inicio su de del estado part""".split(),
    "script": """please browser browser's browsers your settings setting page site website app application web view use using continue run need needs must work works working best function functions properly correctly full features
functionality experience reload refresh them it its on off now then to this that the you we in of and or for cookies required displayed display shown show be is are has been have appears cannot can't can not does doesn't before
order loaded load access visit supported enabled disabled turned switched verify human so with order by all
bitte sie ihr ihrem ihren ihrer browser seite diese dieser dieses website anwendung um zu nutzen verwenden fortzufahren weiter anzeigen angezeigt funktioniert funktionieren damit ein eine aktivieren einstellungen in im den die das
der es ist sind wird werden und oder ohne nicht kann neu laden cookies
veuillez vous devez votre navigateur page site application ce cette pour continuer afficher utiliser utilisation fonctionner fonctionne correctement dans les paramètres le la de du des et ou est sont a être ne peut pas merci d recharger
por favor su navegador página sitio aplicación este esta para continuar ver usar utilizar funcionar funciona correctamente en la los las el de del y o es está tiene no puede se debe ser recargue configuración part""".split(),
}

#: Function words of the corpus languages: they speak for no family and against none.
FUNCTION = """a an the this that these those it its it's is are was were be been being has have had do does did don't not no nothing and or but if so as at by for from in into of off on to with you your we we're we'll our us i my
they them their there here can can't cannot could may might must shall should will would please just like looks look sorry some any all one out up
der die das den dem des ein eine einer eines einem einen dieser diese dieses diesen dieser ist sind war wird werden wurde sein hat haben nicht kein keine und oder aber wenn als bei für von mit auf in im an zu zum zur um aus
sie ihr ihre ihrem ihren ihrer wir uns es ich kann muss müssen soll bitte leider hier da nur auch noch
le la les l' un une des du de d' ce cet cette ces il elle est sont a ont été être ne pas n'est n'a n'avez avez plus et ou mais si comme pour par sur sous dans en au aux à avec vous votre vos nous notre on peut doit devez merci ici
el la los las un una unos unas del de este esta estos estas es son era fue ser ha han haber no ni y o pero si como para por sobre en al a con su sus usted nos se le lo puede debe favor aquí más tiene va""".split()

ABOUT = """how why when which whether who policy policies audit review reviews alert alerts design designs wording timing triage syntax naming rules rule length lengths budget calendar tiers tier bundle size fallback ban bans
plan plans exams expiry limits answers handling guide guidelines history metrics report reports tests tested used comments renaming announce drafts carry reader copy template templates variables escaping
about comparison training dashboard monitoring strategy notes checklist owner meaning examples types type model
auswertung regeln regel richtlinie gestaltung warum wie wann welche prüfung bericht übersicht politique règle règles rapport pourquoi comment quand conception analyse taux
política regla reglas informe cómo cuándo cuáles diseño análisis tasa""".split()
#: Messages that name a setting as often as an error: only with their code.
AMBIGUOUS = ["request timeout"]
#: Terms for such things: where one stands, a text speaks about them.
ABOUT_CORE = ["found rate", "error rate", "maintenance window", "maintenance windows", "maintenance calendar", "error budget", "error page", "error handling", "access review", "access control"]
#: Words of texts that speak about placeholders: where one stands around a slot, the slot is an example.
TALK = "template templates placeholder placeholders variable variables syntax escaping escape naming written interpolation delimiters braces vorlagen platzhaltern modèles plantillas".split()
TALK_ALONG = "how such as are is in the of for and mail rules with like use used by names email to".split()


def stem(word: str) -> str:
    """As :func:`leafline.llm.residue.stems` does it for columns."""
    if word in SPECIAL:
        return word
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return plain[:STEM]


def token(word: str) -> str:
    if word.isdigit():
        return STATUS if word in STATUS_CODES else NUMBER
    if word == "status":
        return STATUS
    return LETTER if len(word) == 1 and word not in "aà" else stem(word)


def cores() -> list[tuple[str, list[str]]]:
    """(family, distinct tokens) of every core phrase, those made by rule included."""
    out = {(f, tuple(sorted({token(w) for w in phrase.split()}))) for f, phrases in CORE.items() for phrase in phrases}
    out |= {("filler", (stem(w),)) for w in LOREM}
    for s in HTTPStatus:
        if s.value >= 400:
            words = [token(w) for w in s.phrase.lower().replace("-", " ").replace("'", " ").split()]
            out.add(("error", tuple(sorted({STATUS, *words}))))
            if len(words) > 1 and s.phrase.lower() not in AMBIGUOUS:
                out.add(("error", tuple(sorted(set(words)))))
    out |= {("error", tuple(sorted({STATUS, stem(w)}))) for w in ("error", "http", "fehler", "erreur")}
    out |= {("script", tuple(sorted({stem(n), stem(v)}))) for n in SCRIPTS for v in SCRIPT_VERBS}
    out |= {("about", tuple(sorted({token(w) for w in phrase.split()}))) for phrase in ABOUT_CORE}
    return [(f, list(words)) for f, words in sorted(out)]


def vocabulary() -> list[tuple[str, str]]:
    """(family, token): words that a text of the family may consist of."""
    out = {(f, w) for f, words in cores() if f != "about" for w in words} | {(f, token(w)) for f, words in ALONG.items() for w in words}
    out |= {(f, token(w)) for f in CORE for w in FUNCTION}
    return sorted(out | {("error", w) for w in (NUMBER, STATUS, LETTER)} | {("filler", w) for w in (NUMBER, LETTER)})
