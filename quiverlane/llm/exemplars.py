"""Labelled exemplars of text that stands where an article's content should.

Fixed values, by label, one wording a line. Each is compared by its terms (residue.py), so a line
stands for its paraphrases in four languages as well.
"""

PLACEHOLDER, INSTRUCTION, FILLER, ERROR, NOTICE = "placeholder", "instruction", "filler", "error", "notice"

#: Written from general knowledge of templates, servers, browsers and converters.
EXEMPLARS = {
    PLACEHOLDER: """
Enter title here
Paper title (use style: paper title)
Titel Ihres Beitrags
Insérez le titre ici
Título de su artículo
Author name here
Authors Name, name of organization, City, Country, email address
Figure caption goes here
Keyword one, keyword two, keyword three
First keyword, second keyword, more keywords
Received: date, accepted: date
Address of first author, address of second author
Manuscript received Month DD, YYYY; revised Month DD, YYYY.
Do you have a subtitle? If so, write it here.
Conference name, month and year, city, country
Lieu et date, nom du laboratoire, adresse de courriel
Name der Einrichtung, Ort, Land
[your text here]
[placeholder text]
Title of the paper
Title
Name of the author
Author one and author two
Insert the title here
Insert the abstract here
Insert the name here
Your title
Your name
Insert table here
Insert figure here
Keyword one; keyword two
Name, address
[Abstract]
[Author]
[Title]
[Figure]
Author A and Author B
TODO
Abstract to be added
Place table here
Author, affiliation
Keyword1; keyword2; keyword3
Insert the section here
Your abstract
Name of the institution
[Name]
[Text]
[Date]
""",
    INSTRUCTION: """
This electronic document is a live template. Do not use symbols or special characters in the title or abstract.
Fügen Sie hier Ihre Zusammenfassung ein.
Inserte aquí el resumen.
Votre texte ici.
Bitte ersetzen Sie diesen Text.
Replace this text with your own. Use the style Body Text.
Your text goes here.
In this section the authors should describe the method. Subheadings may be used.
Dear author, your text belongs here.
Delete this text and replace it with your own before submission.
Please follow the instructions for authors and remove this paragraph.
Acknowledgements should be inserted here.
Describe your results in this section.
This section is left for the authors to complete.
Place your figure here.
To be written by the author.
Text of the section will be added later.
This document is a model and gives instructions for the layout of papers.
Before you begin to format your paper, first write and save the content as a separate text file.
Identify the funding agency here. If there is none, delete this.
Grants or other notes about the article that should go on the front page should be placed here.
Put your references in the bibliography file and remove this example.
Add the text of your conclusion here.
Hier fügen Sie bitte Ihren Text ein.
Hier kommt der Text der Einleitung hin.
Saisissez ici le texte de cette section.
Décrivez ici votre méthode.
Escriba aquí el texto de esta sección.
Describa aquí los resultados.
Insert your abstract.
Insert your text.
Insert your section here.
Insert the section here.
Insert the text here.
Text goes here.
Abstract goes here.
Replace this text.
Replace this section with your own.
Delete this section before submission.
Remove this section.
Describe your methods here.
Please provide an abstract of at most 200 words.
Please provide keywords.
The abstract must not exceed 200 words.
The abstract should summarize the paper in 200 words.
The authors should describe the section.
Use this template.
Instructions for your paper
Remove this section if it is not needed.
Write the content of the section here.
Do not exceed 200 words.
Enter the keywords here.
State the purpose of the section here.
Do not change the layout of the template.
Your section goes here.
Your figure goes here.
""",
    FILLER: """
This is placeholder text.
Hier steht ein Platzhaltertext.
Texte de remplissage.
Este es un texto de ejemplo.
The quick brown fox jumps over the lazy dog.
Dummy text
Placeholder text
Text for the layout of the page
Example text
Insert filler text here.
""",
    ERROR: """
504 Gateway Timeout
400 Bad Request
500 Internal Server Error
503 Service Unavailable
Traceback (most recent call last): File line in module
Segmentation fault (core dumped)
! Undefined control sequence. l.12 ! Emergency stop. No pages of output.
! LaTeX Error: File not found. Fatal error occurred, no output PDF file produced.
Conversion to HTML had a fatal error and exited abruptly.
The document could not be converted. PDF unavailable.
Something went wrong. Please try again later.
An unexpected error has occurred while processing your request.
This site can't be reached. The server refused to connect.
Die Seite konnte nicht geladen werden. Bitte versuchen Sie es später erneut.
Zugriff verweigert. Sie haben keine Berechtigung, dieses Dokument anzuzeigen.
Une erreur est survenue. Veuillez réessayer plus tard.
Accès refusé. Vous n'avez pas l'autorisation de consulter ce document.
Página no encontrada. El documento solicitado ya no existe.
Acceso denegado. No tiene permiso para ver este documento.
File not found or unavailable. The link you followed may be broken.
The web page at this address is temporarily down or has moved permanently.
The document failed to load. Please refresh the page.
Die Umwandlung des Dokuments ist fehlgeschlagen.
La conversion du document a échoué.
La conversión del documento ha fallado.
Gateway error
Server error
Server failed
The server did not respond.
The server could not be found.
No connection to the server.
The service is unavailable.
The service is temporarily down. Please try again later.
The page does not exist.
The page is gone.
The page failed to load.
This page isn't working.
The connection failed.
No connection to the database.
Your session expired, please log in.
You have no permission to view this page.
Unexpected error
An error occurred, please try again.
Fatal error
Fatal error: null
Exception at line 12
Runtime exception: undefined
Null pointer exception
Error: undefined
Syntax error, stack trace
The page could not be converted.
Output failed.
Error: missing, emergency stop
Request timeout
Too many requests
Exception: undefined
The service is temporarily unavailable.
The file could not be converted.
401 Unauthorized
405 Method Not Allowed
409 Conflict
413 Payload Too Large
415 Unsupported Media Type
501 Not Implemented
505 HTTP Version Not Supported
The connection was reset while the page was loading.
The server took too long to respond.
Secure connection failed
Sorry, you have been blocked.
You are being rate limited.
Web server is down
Missing $ inserted.
Missing number, treated as zero.
Illegal unit of measure (pt inserted).
Misplaced alignment tab character.
Dimension too large.
Paragraph ended before the command was complete.
Runaway argument? File ended while scanning use.
Emergency stop. Fatal error occurred, no output file produced.
Command not found
No such file or directory
Permission denied
Out of memory
Index out of range
Object reference not set to an instance of an object.
Division by zero
Traceback (most recent call last)
The request timed out.
An unexpected error has occurred.
""",
    NOTICE: """
JavaScript must be enabled to use this site.
Please enable cookies and reload the page.
We use cookies to improve your experience. Accept all cookies.
Please complete the security check to continue.
Bitte aktivieren Sie Cookies, um fortzufahren.
JavaScript ist in Ihrem Browser deaktiviert.
Votre navigateur doit accepter les cookies pour continuer.
Este sitio requiere cookies y JavaScript para continuar.
Please turn on JavaScript and try again.
This content needs scripts to be allowed in your browser.
We need to check that you are not a robot before you continue.
Ihr Browser unterstützt die nötigen Skripte nicht.
Votre navigateur ne prend pas en charge les scripts de cette page.
Su navegador no admite los scripts que necesita esta página.
Enable scripts.
Scripts are disabled.
This page needs scripts.
No view without scripts.
Your browser needs scripts.
Your browser blocks scripts.
Accept cookies.
Please accept scripts.
Verify that you are human.
Confirm that you are not a robot to continue.
Verifying your browser.
Checking the connection of your browser.
Update your browser to view this page.
Checking whether the connection to the site is secure
Cannot be displayed without scripts.
Please stand by while we are checking your browser.
Why do I have to complete a CAPTCHA?
Please confirm you are human.
Please disable your ad blocker.
Your browser is outdated.
""",
}

#: Labelled rows: wordings that stand in the given tables (sf0.1 and the check's), one line each. The
#: tests leave them out to measure the recall of the others on them.
GIVEN = {
    PLACEHOLDER: """
Your Paper Title
Type your title
Title of Paper Goes Here
[Title of the Article]
Article Title (max. 15 words)
Insert Title Here
Click to add title
Titel der Arbeit hier eintragen
Titre de votre article
Escriba aquí el título
Author Name(s)
Firstname Lastname
First Author and Second Author and Third Author
Name of author one, Affiliation of author one
Given-name Surname, Department, University, City, Country
[AUTHOR 1], [AUTHOR 2]
Vorname Nachname
Prénom NOM
Nombre Apellido, Institución
<Abstract, 150--250 words>
[INSERT TABLE 1 HERE]
<insert figure 1 about here>
undefined undefined
Grant number: XXXXXX-XX; DOI: 10.XXXX/XXXXXXX; received: DD Month YYYY.
""",
    INSTRUCTION: """
Your abstract goes here. It should not be longer than 200 words.
Insert your abstract here. Include up to five keywords.
The abstract should summarize the contents of the paper and replace this paragraph.
This is where the abstract will be typed. Do not cite references in it.
Please write a short summary of the work in this place (200 words at most).
Hier steht Ihre Zusammenfassung mit höchstens 200 Wörtern.
Insérez ici le résumé de votre article (200 mots au plus).
Escriba aquí el resumen de su trabajo, de no más de 200 palabras.
Remplacez ce paragraphe par votre texte.
Sustituya este párrafo por su propio texto.
Dieser Abschnitt ist durch Ihren Text zu ersetzen.
Type the text of this section here.
Subsection text. Add your content below this line.
Write your introduction here; delete this paragraph before submission.
[to be filled in by the author: related work]
Lead-in sentence. Supporting sentence one. Supporting sentence two. Closing sentence.
""",
    FILLER: """
This is dummy text.
Some sample text to fill the page.
Here is filler so that the layout can be judged.
Text text text text.
Filler text filler text.
Dummy text dummy text.
Dies ist ein Blindtext.
Ceci est un faux texte.
Texto de relleno.
""",
    ERROR: """
404 Not Found
403 Forbidden
HTTP 502 Bad Gateway
Internal Server Error. The server met an internal error and could not complete your request. Reference: 123
503 Service Temporarily Unavailable. The server is down for maintenance; please try again in 10 minutes.
The requested page was not found on this server.
Error 404: page not found. Go back to the paper list.
Sorry, the page you are looking for has been moved or no longer exists.
Access denied. You do not have permission to view this article (code 123).
We could not load this article. Reload the page or contact support with ID 123.
Your session has expired. Please log in again to read the article.
The connection has timed out while fetching document 123.
Too many requests. Your address has been rate limited, retry after 30 s.
Error establishing a database connection
{"error":{"code":500,"message":"document unavailable"}}
Fatal error: Uncaught exception 'RenderFault' in /srv/app/render.inc:12. Stack trace: #0 main
Conversion failed: source archive 123.tar.gz is empty. No output was produced.
Seite nicht gefunden. Das gewünschte Dokument 123 existiert nicht mehr.
Page introuvable (erreur 404). Le document demandé n'est pas disponible.
Error 500: no se pudo procesar la solicitud. Inténtelo más tarde.
""",
    NOTICE: """
Please enable JavaScript to view this article.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. Turn it on and reload the page.
Your browser does not support the scripts that this page needs.
<noscript>This page only works with scripts switched on.</noscript>
Formulas are rendered by MathView, which needs JavaScript; it seems to be turned off.
This site requires cookies and scripts. Please switch both on to continue.
Verify that you are human. Enable JavaScript and cookies to continue.
Checking your browser before you may access the article... This process is automatic.
Bitte aktivieren Sie JavaScript, um den Artikel zu lesen.
Veuillez activer JavaScript pour afficher cette page.
Active JavaScript en su navegador para ver el contenido.
""",
}

#: The stock words of Latin filler, which come in any order.
LATIN_FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
culpa qui officia deserunt mollit anim id est laborum vitae diam cursus eget semper turpis felis lectus ligula augue purus
neque nunc tortor orci mollis libero risus massa urna mauris ante arcu porta vestibulum pellentesque fringilla nec
vel ac at a suspendisse praesent donec nam fusce aenean morbi integer nullam etiam vivamus sapien justo metus odio
habitant tristique senectus netus malesuada fames egestas perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium
consequuntur magni dolores eos ratione sequi nesciunt curabitur pretium tincidunt lacus gravida varius pharetra vulputate dapibus hendrerit
ultrices ultricies posuere tellus nisl nibh sodales sagittis congue interdum blandit volutpat
"""

#: Those of them that are common words of the four languages.
COMMON_FILLER = "a at in do non et est id ex nec ac ut eu ea culpa esse qui nam integer"

#: Commands that print filler.
FILLER_COMMANDS = "lipsum blindtext Blindtext blindmathpaper blinddocument Blinddocument blindlist blindenumerate blinditemize kant zhlipsum".split()

#: Names of the parts of an article, as they stand in the slots of templates.
SLOT_NAMES = "title subtitle author authors name names abstract keywords date affiliation affiliations institution email section sections body text content introduction summary titel autor autoren zusammenfassung titre auteur auteurs résumé título titulo autores resumen figure table caption".split()
