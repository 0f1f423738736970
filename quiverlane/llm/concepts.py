"""Words of one meaning, in four languages: what the residue operator compares instead of words.

Fixed values. A word stands for the first meaning that lists it; a star ends the beginning of words.
"""

from __future__ import annotations

from functools import lru_cache

MEANINGS = {
    "script": "javascript java-script js script scripts scripting scripte skript skripte skripten cookie cookies noscript adblocker popups",
    "browser": "browser browsers webbrowser navigateur navigateurs navegador navegadores",
    "enable": "enable enabled enabling disable disabled activate activated deactivated switch switched turn turned allow allowed unblock block blocked blocking blocks aktiviere* deaktiviert aktiviert einschalten schalten ausgeschaltet eingeschaltet zulassen zugelassen erlauben erlaubt erlaube* blockiert activer activez activé activés désactivé désactivés désactivée autoriser autorisez autorisé bloqué bloque habilitar habilite habilita activar desactivado desactivada* desactivados deshabilitad* bloquea permita permitir permiten lassen lass off blockieren bloquean restrict restricted enables allows unblocked einzuschalten aktivieren aktivierung freischalten permettre permettez permettent débloquer desbloquear autorizar autorice encender encienda active activo activado activada habilitado habilitada",
    "accept": "accept accepts accepting akzeptieren akzeptiere* accepter acceptez aceptar acepte",
    "require": "require requires required requiring need needs needed must support supports supported requirement benötigt benötigen erfordert braucht muss müssen unterstützt nötig* nécessite nécessitent nécessaire requiert doit devez requiere requieren necesita necesitan debe deben admite necessary mandatory braucht voraus setzt notwendig exige exigent besoin faut requis requise precisa exige requerido necesario necesaria",
    "item": "page pages site website websites webpage app application article articles paper papers document documents resource resources url seite seiten webseite website artikel dokument dokuments dokumente dokumentes anwendung documento documentos artículo artículos página páginas sitio aplicación fichier fichiers archivo file files datei dateien content contents inhalt inhalte contenu contenido manuscript manuscripts manuskript manuskripts manuscrit manuscrito beitrag beitrags",
    "view": "view viewing read display displayed displays see show shown access visit loads load loading loaded lesen anzeigen angezeigt ansehen zugreifen laden geladen nutzen afficher affiché affichée consulter lire voir charger chargé chargée accéder ver leer mostrar acceder cargar cargado cargada run reach reached use funktioniert fonctionne funciona work works working properly usar utiliser verwenden benutzen accessing reading using watch opening anzuzeigen ansicht aufrufen darstellen dargestellt angesehen visualiser voir visualizar abrir ouvrir utilisez utilice nutzung",
    "please": "merci please kindly sorry bitte veuillez merci favor désolé désolés lamentamos ruego rogamos prière excuse apologies apologise apologize entschuldigung entschuldigen lamentablemente leider malheureusement",
    "again": "again later retry reload refresh reloading shortly minutes moment wait erneut später nochmals nochmal neu warten minuten réessayer réessayez recharger rechargez actualiser ultérieurement patienter nuevo tarde inténtelo intente recargue recargar actualice einmal unos später späteren",
    "continue": "continue continuing proceed proceeding fortfahren fortzufahren weiter continuer poursuivre continuar proseguir resume weitermachen weiterlesen reprendre seguir step schritt étape paso",
    "human": "human robot robots bot mensch roboter humain robot humano menschlich person humans automated captcha captchas",
    "verify": "verify verifying verification checking confirm challenge überprüfen überprüfung überprüft prüfen bestätigen bestätige* sicherheitsprüfung vérifier vérification vérifions confirmez confirmer comprobando comprobar verificar verificación verifique confirme security secure sicher sécurisée seguro bestätigen checks verified validate prüft bestätigung prouvez prouver demuestre compruebe valide validez",
    "error": "error errors failure warning fehler erreur erreurs fallo falla",
    "crash": "exception exceptions fatal fault panic traceback segmentation crash crashed serverfehler *error *exception *fault",
    "failed": "failed fail fails unable cannot can't couldn't impossible unexpectedly abruptly aborted broken fehlgeschlagen gescheitert unmöglich konnte konnten échoué échec fallado falló wrong occurred happened encountered aufgetreten survenue survenu producido ocurrido pudo podido isn't doesn't don't invalid keine unsuccessful interrupted ungültig abgebrochen gescheitert interrompu invalide inválido inválida interrumpido snap inesperado inattendu inattendue unerwartet unerwarteter unerwartete isn doesn couldn wasn",
    "gone": "found missing unavailable available gone moved removed exist exists existed nonexistent broken gefunden verfügbar existiert entfernt verschoben introuvable disponible indisponible existe encontrada encontrado movida eliminado trouvée trouvé indisponibles unreachable nichtverfügbar inexistent unreachable erreichbar auffindbar existierte existieren accessible inaccessible trouver encontrar existen hallado localizado localizar supprimé supprimée déplacé déplacée deleted gelöscht",
    "server": "server servers gateway proxy upstream http https timeout serveur serveurs servidor webserver backend origin webservers",
    "service": "service services database host connection connections connect request requests requested response link network datenbank dienst dienste verbindung anfrage angeforderte angefordert gewünschte requête demandé demandée cherchez connexion conexión solicitud solicitado solicitada servicio busca looking followed address answer responded antwortet reagiert répond responde",
    "denied": "denied forbidden unauthorized unauthorised authorized authorised permission permissions session sessions expired login log logged sign verweigert zugriff berechtigung berechtigungen berechtigt sitzung abgelaufen anmelden melden refusé accès autorisation session expiré expirée connecter reconnecter denegado acceso permiso permisos sesión caducado caducada expirado limited refused reset privileges unzulässig gesperrt untersagt interdit interdite refusée prohibido prohibida denegada autorizado autorizada identifier identifiez relogin anmeldung einloggen",
    "down": "temporarily temporary maintenance down overloaded busy vorübergehend wartung wartungsarbeiten temporairement maintenance temporalmente mantenimiento currently derzeit actuellement actualmente internal interner interne interno overload ausgefallen überlastet gestört fuera panne surchargé timed",
    "status": "404 403 401 400 408 410 429 500 502 503 504 402 405 406 407 409 411 412 413 414 415 416 417 421 422 423 424 425 426 428 431 451 501 505 507 508 510 511",
    "convert": "conversion convert converted rendering rendered render renderer generation generate generated compilation compiled output pdf html tex latex umwandlung umgewandelt konvertierung konvertiert convertir converti conversión convertido",
    "trace": "stack trace undefined syntax heap recursion recursive dumped core uncaught null properties sequence emergency stop runaway unrecoverable parse stacktrace eof unexpected environment java php",
    "insert": "insert inserted type typed enter add added write written put place placed paste fill filled provide click describe describes replace replaced replacing delete remove list state summarize contain contains include einfügen eingefügt fügen eintragen eingetragen eingeben geben eingabe ersetzen ersetzt schreiben beschreiben löschen entfernen insérer insérez saisir saisissez remplacez remplacer supprimez supprimer décrivez écrivez rédigez ajoutez ajouter inscrivez renseignez inserte insertar escriba escribir sustituya reemplace elimine borre describa agregue añada introduzca complete beschreibe* lösche* ersetze* paste provides supply specify indicate use setzen stellen tragen verfassen angeben ergänzen streichen indiquez indiquer mettez mettre placez entrez tapez collez modifiez inscrire écrire décrire rédiger ingrese coloque ponga redacte rellene indique incluya quite suprima borrar eliminar añadir insertado insérée inséré remplacé remplacée reemplazado sustituido prepare preparing",
    "here": "here hier hierher hierhin ici aquí below unten ci-dessous abajo",
    "goes": "goes belongs steht stehen kommt go belong gehört gehören va vont van",
    "your": "your yours ihr ihre ihren ihrer ihres ihrem dein deine votre vôtre vos su sus suyo own propio propia eigener eigenen yourself ihrige deinen deinem tu tus ton ta tes",
    "title": "title titles subtitle titel untertitel titre título untitled überschrift titelzeile encabezado headline",
    "name": "name names firstname lastname forename surname initials vorname nachname namen prénom nom noms nombre nombres apellido apellidos given jr sr",
    "author": "author authors co-author corresponding autor autoren autorin auteur auteurs autores verfasser autors autorin autorinnen",
    "place": "affiliation affiliations department institution institute university city country email e-mail address einrichtung abteilung universität ort land anschrift adresse institution université ville pays courriel institución universidad ciudad país correo organisation organization einrichtungen fakultät faculté faculty hochschule laboratory laboratoire labor lugar lieu",
    "abstract": "abstract summary zusammenfassung kurzfassung résumé resumen",
    "keyword": "keyword keywords index indexing schlüsselwort schlüsselwörter schlagwort schlagwörter stichwörter clés clave",
    "section": "section sections subsection subsections paragraph paragraphs introduction conclusion conclusions acknowledgment acknowledgments acknowledgements acknowledgement results methods method discussion body heading headings subheadings abschnitt abschnitts einleitung absatz ergebnisse methode kapitel paragraphe conclusion méthode résultats sección párrafo introducción conclusión resultados método sentence satz preliminaries experiments background model related work main préliminaires expériences experimente grundlagen preliminares experimentos abschnitte unterabschnitt apartado sous-section partie einführung danksagung remerciements agradecimientos discussion diskussion discusión schluss fazit schlussfolgerungen conclusiones theory theorie théorie teoría modell modelle modèle modelo numerical limitations data daten données datos analysis analyse análisis setup evaluation auswertung évaluation evaluación outlook ausblick perspectives materials materialien matériel materiales appendix anhang annexe apéndice notation notación",
    "figure": "figure figures table tables caption captions abbildung tabelle legende tableau tabla figura",
    "text": "text texts texte textes texto textos textes fließtext haupttext textkörper cuerpo corps",
    "words": "words word wörter wörtern mots palabras maximal maximum max máximo longer exceed dépasser superar long exceeded characters zeichen caractères caracteres limit höchstens overlength wortzahl límite limite capitalize capitals",
    "template": "template templates guidelines instructions instruction vorlage modèle plantilla submission submitting submit einreichung soumission soumettre enviar envío styleguide layoutvorlage anleitung hinweise consignes directrices instrucciones gabarit einreichen eingereicht eingereichten submitted",
    "blind": "dummy placeholder placeholders filler blindtext platzhalter platzhaltertext beispieltext fülltext fülltexts remplissage factice relleno xxx foo fülltext mustertext lückenfüller bouche-trou simulado fictif fictive",
    "example": "sample example exemple ejemplo beispiel provisoire provisional faux layout maquetación gestaltung bar demo beispiele muster échantillon muestra illustration illustrative mise",
    "ordinal": "first second third one two three four",
}

#: Words that say nothing of the matter. Those of authors about themselves (we, our, was, were) aren't among them.
LITTLE = """
a an the this that these those it its is are be been being has have had to of in on at by for from with without and or not no nor if you which who what when
where while so as but than then there also will would should can could may might do does did done only just any all some each more most up out off into about over under
very too through after before until during s t m re
their enough detail details briefly clearly concisely properly purpose purposes right now there both ever
der die das den dem des ein eine einen einem einer eines dieser diese dieses diesen diesem und oder nicht kein keine ist sind sein wird werden wurde sie es um zu zur zum auf an in im
von vom mit ohne für bei aus als auch noch nur kann können dass durch bis nach vor über ein ab einigen mehr einmal
möglich bereits bin bist seid werde würde müsste
êtes suis sommes sera soit
le la les l un une avant après
le la les l un une des du de d ce cet cette ces et ou ne pas n est sont être a ont à au aux en dans sur sous pour par avec sans que qui se vous il elle plus son sa ses y
el los las una unos unas de del al y o no es son ser ha han en con sin por para que se lo le este esta estos estas esto ese esa más un sido ha antes está están usted ustedes eres son sea
"""


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]:
    whole: dict[str, str] = {}
    begins, ends = [], []
    for meaning, listed in MEANINGS.items():
        for w in listed.split():
            if w.endswith("*"):
                begins.append((w[:-1], meaning))
            elif w.startswith("*"):
                ends.append((w[1:], meaning))
            else:
                whole.setdefault(w, meaning)
    for w in LITTLE.split():
        whole.setdefault(w, "")
    return whole, tuple(begins), tuple(ends)


def meanings() -> dict[str, str]:
    """The words that are listed in full, with their meanings."""
    return _tables()[0]


@lru_cache(maxsize=200_000)
def meaning(word: str) -> str:
    """The meaning of a word in lower case, in angles; the word itself if it is of none, nothing if it says little."""
    whole, begins, ends = _tables()
    held = whole.get(word)
    if held is None:
        held = next((m for b, m in begins if word.startswith(b)), None) or next((m for e, m in ends if len(word) > len(e) + 2 and word.endswith(e)), None)
    return word if held is None else f"⟨{held}⟩" if held else ""
