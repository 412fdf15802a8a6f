"""Texts for measuring the residue rules on wordings they weren't made from.

Written before the rules of residue.py in their present form, from general knowledge of what sites show; none is taken from a
corpus, and rules aren't to be changed for the sake of single lines here.
"""
RESIDUE = """
This application requires JavaScript to run.
You need to enable JavaScript to run this app.
We're sorry but this site doesn't work properly without JavaScript enabled. Please enable it to continue.
Please turn on JavaScript and reload the page.
JavaScript is not available. We've detected that JavaScript is disabled in this browser.
Your browser does not support JavaScript!
Enable JavaScript and cookies to continue
Scripts are blocked by your browser settings; this content needs them.
Um diese Website zu nutzen, müssen Sie JavaScript aktivieren.
Für diese Seite wird JavaScript benötigt.
Ce site nécessite JavaScript pour fonctionner.
JavaScript est désactivé dans votre navigateur.
Esta página requiere JavaScript.
Este site precisa de JavaScript para funcionar.
Для работы сайта необходимо включить JavaScript.
このサイトを表示するにはJavaScriptを有効にする必要があります。
404. That's an error. The requested URL was not found on this server.
Error establishing a database connection
You don't have permission to access this resource.
500 Internal Server Error
The server encountered an internal error or misconfiguration and was unable to complete your request.
This page isn't working right now.
Sorry, the page you are looking for doesn't exist.
Oops! That page can't be found.
Whoops, looks like something went wrong.
An unexpected error occurred. Please try again later.
Service Unavailable - DNS failure
The service is temporarily unavailable.
We'll be back soon! Sorry for the inconvenience, we are performing some maintenance.
Website is under maintenance
Your session has timed out. Please log in again.
You have exceeded your rate limit.
Attention Required! Please complete the security check to access this site
Please verify you are a human
Sorry, you have been blocked
Access to this page has been denied because we believe you are using automation tools.
This video is not available in your country.
This account has been suspended.
502 Bad Gateway nginx/1.18.0
Application error: a client-side exception has occurred
Traceback (most recent call last):
Fatal error: Uncaught Exception in /var/www/html/index.php on line 12
Warning: mysql_connect(): Access denied for user
Notice: Undefined index: id in /home/site/page.php on line 7
Seite nicht gefunden (404)
Die angeforderte Seite konnte nicht gefunden werden.
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Erreur 404 : page introuvable
Une erreur est survenue.
La página que buscas no existe.
Se ha producido un error inesperado.
Ocorreu um erro ao processar sua solicitação.
Ошибка 404. Страница не существует.
Произошла ошибка.
お探しのページは見つかりませんでした。
エラーが発生しました。
Access denied (contact the administrator of the site named above and quote the reference number that is shown at the lower end of this page, together with the time at which you tried to open it and the name of the browser)
Dear {customer}, your invoice is attached.
Hello [First Name],
Hi %FIRSTNAME%, thanks for joining!
Dear <Customer Name>,
{{ article.title }}
${user.email}
[Insert product description here]
<%= user.name %> wrote:
Copyright [year] [company name]
Hi $firstname,
%%FIRST_NAME%%, don't miss out
Sehr geehrte/r [Name],
TODO: write description
[object Object]
Price: NaN
Hello undefined!
Published on Invalid Date
<your name here>
Enter your text here...
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
This is sample text. Replace it with your own content.
Your content goes here. Edit or remove this text inline.
Click here to edit this text.
asdf asdf asdf asdf
blah blah blah blah blah
Hier könnte Ihr Text stehen.
Dies ist ein Typoblindtext.
Texte à remplacer.
Aquí va el texto.
Insira o seu texto aqui.
Текст-рыба
ここにテキストを入力してください。
Just another WordPress site
Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
""".strip().split("\n")

ORDINARY = """
I had to enable JavaScript in the test browser before the page loaded.
Why does the server answer 404 Not Found for a page that exists?
We return 403 Forbidden when the token is missing, which is on purpose.
The template engine replaces every placeholder before the mail goes out.
My session expired while I was typing, so I lost the draft.
Lorem ipsum is a filler text used by printers since the sixteenth century.
Does anyone know how to catch an internal server error in this framework?
You can disable scripts in the settings menu if the page is slow.
The page was not found in the archive, so I scanned it again.
Access to the roof is denied to visitors after six.
Thanks, that worked for me.
Nach dem Neustart wird die Seite nicht gefunden, obwohl die Datei da ist.
J'ai dû activer JavaScript pour voir le menu.
¿Por qué aparece la página de error cuando cambio el tema?
O erro sumiu depois que reinstalei o pacote.
Почему страница не найдена после обновления?
更新したらページが見つからなくなったのですが、なぜでしょうか？
The variable is undefined until the first call returns.
If the value is null the loop stops early.
JavaScript is a programming language that runs in the browser.
The test suite runs test after test until one fails.
Under maintenance contracts the supplier replaces the pump.
The error message was about a missing file, not about permissions.
Try again later in the season, when the soil is warmer.
Our service was unavailable for two hours because a disk was full.
Set the status to 404 and log the request.
Fill in the form and send it to the office.
Die Datei wurde nicht gefunden, weil der Pfad falsch war.
Un texto de ejemplo ayuda a ver el diseño.
Add a to-do list to the page so that people see what is open.
Hello Anna, the parcel arrived this morning.
Contact the seller and ask for a refund.
The array holds [1, 2, 3] and the map {a: 1}.
Prices start at $20 and go up to $100 in summer.
The forbidden zone is marked with red poles on the map.
Wir haben die Wartung auf Montag verschoben.
El servidor de pruebas está en el sótano.
La page suivante explique le montage.
Страница журнала лежит на столе.
次のページで手順を説明します。
""".strip().split("\n")
