"""Template residue, filler, error-page messages and script notices in documents.

Each text is stripped of what only shows such text (code, quotations, block quotes), and its numbers, addresses, dates and
template fields are masked, as are runs of dummy Latin, of keys hit at random and of one repeated word. It is then cut to units:
paragraphs, lines, sentences, and the head of a sentence before a colon, bracket or dash. So copies of a message from all sources
become one key. Keys are grouped by exact hash over the whole corpus; those that recur in at least `min_docs` documents of at least
`min_sources` sources are classified by phrase and placeholder rules, and the documents that hold a key so classified are found.
What doesn't recur isn't residue, whatever it says.
"""
from __future__ import annotations

import html
import re as std
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.sources import source_key
from pointlake.session import small, spread, stage

# ---- what only shows text
_I = re.I | re.M
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b[^<>]*>(?!\s*\d{3}\s*</code>).*?(?:</code>|\Z)|^(?: {4}|\t).*$|`[^`\n]+`|<blockquote\b.*?(?:</blockquote>|\Z)|^[ \t]*>.*$", re.S | _I)
QUOTE = re.compile(r"""(?<![\w])"(?:[^"\n]|\n(?!\s*\n))*"|“(?:[^”\n]|\n(?!\s*\n))*”|«[^«»]*»|„[^“”„]*[“”]|「[^」]*」|『[^』]*』|‘[^’\n]*’(?!\w)|(?<![\w'])'(?=\S)[^'\n]*(?:'(?=\w)[^'\n]*)*'(?!\w)""")
MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]*[\\^<>=][^$\n]*\$|\$\w_?\{?[\w,]*\}?\$", re.S)
LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?!\[)[^()\n]*\)?|https?://\S+|www\.\S+")
BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|h[1-6]|hr|tr|td|table|center|head|body|html|title|noscript|span|b|i|em|strong|a|meta|link|style)\b[^<>]*>", re.I)
RAW_ERROR = re.compile(r'^\s*\{\s*"(?:error|status)"\s*:\s*(?:\{|[45]\d\d\b)|^\s*<error><code>[45]\d\d</code>|^(?:\s|<html>|<head>|<!doctype[^<>]*>)*<title>\s*[45]\d\d [a-z ]+</title>|^\s*<h1>\s*(?:[45]\d\d )?[a-z -]{4,40}</h1>\s*<p>\s*\(?[45]\d\d\b|^\s*<(?:html|!doctype)[^\n]*<title>[^<>]*\b[45]\d\d\b', _I)

# ---- template fields
_WORD = r"[\p{L}_](?:[\p{L}\p{N}_.\-]| (?=[\p{L}_]))*"
# Names of fields as forms and mails use them.
FIELDS = "name first_name last_name full_name customer customer_name client client_name company_name recipient username user user_name display_name user_display_name title body text topic subject product product_name category tag tags tag_list votes date year time signature reply author email phone address street company city country summary excerpt post_excerpt question question_text answer answer_body link url link_url site site_name website message content amount price invoice_number order_number".split()
_FIELD = "(?:" + "|".join(sorted((f.replace("_", "[_. -]?") for f in FIELDS), key=len, reverse=True)) + r")(?:[_.][a-z]{2})?"
PLACEHOLDER = re.compile("|".join([
    r"\{\{\{?\s*[^{}\n]+?\s*\}?\}\}", r"\{%[^%\n]+%\}", r"<%[^%\n]+%>", rf"%%\s*{_WORD}\s*%%", rf"\*\|\s*{_WORD}\s*\|\*", r"\{![^!\n]+!\}",
    r"\#\{[^{}\n]+\}", rf"\$\{{\s*{_WORD}\s*\}}", rf"@@\s*{_WORD}\s*@@", r"(?<!\w)__(?-i:[A-Z][A-Z_. ]+[A-Z])__(?!\w)", rf"\[\[\s*{_WORD}\s*\]\]", rf"<<\s*{_WORD}\s*>>",
    r"(?<![\w\\])(?-i:\$[A-Z][A-Z_.]{2,}\$?)(?!\w)", r"(?<!\w)(?-i:%[A-Z][A-Z_]{3,}%)(?!\w)", rf"(?<![\w\\])\${_FIELD}(?!\w)", r"\[(?:your|insert|enter|ihre?n?|votre|insérez|su|tu|inserte|seu|sua|insira|ваш\w*|вставьте)\b[^\[\]\n]+\]", r"<(?:your|insert|enter|ihre?n?|votre|su|tu|seu|sua|ваш\w*)\b[^<>\n]+>",
    r"\[[^\[\]\n]*?(?:入力|記入|\b(?:einfügen|ergänzen|eintragen|ausfüllen|compléter|remplir|completar|rellenar|preencher|inserir|escriba|escreva|écrivez|вставить|заполнить|дополнить|укажите|введите))[^\[\]\n]*\]",
    rf"%\({_WORD}\)s", r"(?-i:\[[A-Z][A-Z_. ]{2,}\])", rf"\[{_FIELD}\]", r"<[A-Za-z]+(?:[_.][A-Za-z]+)+>", r"(?-i:<(?!DOCTYPE)[A-Z_]{4,}>)", rf"<{_FIELD}>", rf"(?<![\w\\$}}])\{{{_FIELD}\}}",
    r"(?<![\w\\$}])\{[0-9]\}", r"〇〇様?", r"\[object object\]",
]), re.I)
_MAY_HOLD = re.compile(r"[\[<{%$*@_#〇]")
# Sentences that speak of fields instead of leaving them unfilled.
ABOUT = re.compile(r"\bescapes?\b|\bformat string\b|\bplaceholders?\b.*\b(?:syntax|means?)\b|\bexport <f>|\bdelimiter|\bbraces\b|\bsyntax\b|\bset <f> to\b|\bvariables? <f>(?! in )")

# ---- masks
# Words of the usual dummy Latin, the standard passage first.
LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum curabitur pretium tincidunt lacus gravida orci odio nullam varius turpis pellentesque habitant morbi tristique senectus netus malesuada fames ac egestas vestibulum praesent mauris suspendisse aenean donec vivamus maecenas fusce phasellus integer sapien ligula quam justo nibh tortor metus cras proin sodales vehicula ultrices posuere faucibus luctus tellus viverra augue felis bibendum condimentum rhoncus volutpat dapibus interdum feugiat mattis porttitor".split())
# Those that hardly occur in other texts.
_SEED = re.compile(r"\b(?:lorem|ipsum|consectetur|adipis\w+|eiusmod|incididunt|aliqua|veniam|nostrud|ullamco|laboris|aliquip|reprehenderit|voluptate|cillum|fugiat|pariatur|excepteur|occaecat|cupidatat|proident|deserunt|mollit|laborum|curabitur|tincidunt|pellentesque|vestibulum|praesent|suspendisse|aenean|donec|vivamus|maecenas|phasellus)\b")
# Frequent words of living languages that dummy Latin doesn't have.
_LIVING = set("the is of and to it for this that with as by on are be or like i you der die das und ist nicht ein eine mit zu le la les des une pour dans que un el los las una por para con del o os uma com não é il di che".split())
_MASHED = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|^[bcdfghjklmnpqrstvwxz]{3,}$|q(?!u)|[jvxwz][bcdfgjkmnpqtvwxz]|[aeiou]{4}")
_DATE = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ t]\d{1,2}:\d{2}(?::\d{2})?)?|\d{1,2}:\d{2}(?::\d{2})?|\b\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4}\b")
_MAIL = std.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_NETWORK = std.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b|\b(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{1,4}\b")
_STREET = std.compile(r"\b\d+ (?:\w+ ){1,3}(?:street|st\.|road|rd\.|avenue|ave\.|lane|drive|boulevard|blvd\.)(?!\w)|\b\d+,? (?:rue|avenue|boulevard|calle|rua) (?:\w+ ?){1,4}|(?<=[a-zß])(?:straße|strasse|weg|platz) \d+\b")
_STREETS = ("street", " st.", "road", " rd.", "avenue", " ave.", "lane", "drive", "boulevard", " blvd.", "rue ", "calle ", "rua ", "straße", "strasse", "weg ", "platz ")  # what _STREET needs
_FILE = std.compile(r"(?<![\w</])/(?:[\w.-]+/)+[\w.-]*|(?<![\w</.])[\w-]+(?:/[\w.-]+)+\.[a-z]{1,5}\b|(?<!\w)[a-z]:\\[\w\\.-]+")
_NAME = std.compile(r"\$[a-z_]\w*|\w+\(\)|(?<!\w)[a-z][^\W_]*_\w+")
_NUMBER = std.compile(r"\d+")
_HEX = std.compile(r"\b(?=[a-f\-]*\d)[\da-f]{5,}(?:-[\da-f]+)*\b")
_BLANKS = std.compile(r"[^\S\n]+")
_SAME = std.compile(r"(?<!\S)(\S{2,}+)(?:\s++\1(?!\S)){3,}")
_SCRIPTS = re.compile(r"(?:(?<!\w)cookies and )?(?:java ?script|(?<!\w)(?:(?:client-side )?scripts?|scripting|js|скрипты?)(?![a-zа-я])|スクリプト)(?: and cookies(?!\w))?")
# What a site calls the things that it shows.
THINGS = "page site website forum board view app application thread topic post answer reply question comment article document resource file url address item link discussion".split()
_THING = std.compile(r"\b(?:(?:the|this|that|your) )?(?:(?:requested|full) )?(?:" + "|".join(sorted(THINGS, key=len, reverse=True)) + r")s?\b(?: 0\b)?|\b(?:the|this|that|your) request\b")
_LETTER, _WORDS = re.compile(r"\p{L}"), re.compile(r"\p{L}+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|(?<=。)(?=[^\s。!?！？)）\]」』】])|(?<=[!?！？])(?=[\p{Han}\p{Hiragana}\p{Katakana}]|(?<=[\p{Han}\p{Hiragana}\p{Katakana}ー].)[\p{L}\p{N}])")
_CUT = std.compile(r"\s*[(:;|–—（：)]\s*|\s+-\s+|,\s+|\s+(?=(?:while|before|until|so that|in order to|to (?:continue|see|view|use|read|load|get|show|display|run|proceed))\b)")
_EMPTY = (" undefined", " null", " nan")
_TIGHT, _PARAGRAPH = std.compile(r" (?=[,.!?:;)])|(?<=\() "), std.compile(r"\n\s*\n")
_HIDDEN = re.compile(r"[\u00ad\u200b-\u200d\u2060\ufeff]")

# ---- rules; they see masked units in lower case
# What authors say of themselves, ask or explain: such units are talk, not messages.
TALK_WORDS = frozenset("i i'm i've i'd i'll my mine anyone somebody someone why which although because fix handler instead mock-up ich mein meine meinen meinem meiner mir warum wieso weil obwohl damals je mon ma mes pourquoi parce yo mi porque aunque eu meu minha я мой моя мне почему потому".split())
TALK_PHRASES = ("have you", "let me", "used to", "on purpose", "how do", "how does", "how can", "how could", "how to", "how would", "por qué", "por que", " j'", " j’", "なぜ", "どうして", "でしょうか", "ますか", "? ", "¿")


def talk(key: str) -> bool:
    """Whether a unit is talk of authors, not a message."""
    return not TALK_WORDS.isdisjoint(key.replace(",", " ").replace(";", " ").split()) or key.endswith("?") or any(p in key for p in TALK_PHRASES) or key.startswith(("j'", "j’"))


_ON = r"(?:enabled?|enabling|required?|requires|needs?|needed|turn(?:ed)? on|switch(?:ed)? on|allow(?:ed)?|activated?|must be|disabled|blocked|turned off|seems? to be off|is off|are off|does not support|doesn't support|not supported|not running|without|works? only|only works?|not available|cannot be|benötigt|erforderlich|aktivieren|aktiviert|deaktiviert|einschalten|schalten|erlauben|nécessite|nécessaire|requis|activer|activez|autoriser|autorisez|désactivé|requiere|necesita|habilitar?|habilite|activar?|active|desactivado|precisa|necessário|ativar|ative|permitir|permita|desativado|requer|включит[ье]|разреши(?:те|ть)|требуется|необходим\w*|нужн\w*|отключ\w*)"
SCRIPT = re.compile(rf"<js>.*?(?<!\w){_ON}(?!\w)|(?<!\w){_ON}(?!\w).*?<js>|<js>.{{0,12}}(?:有効|オン|必要|無効|許可)|<js> ein(?:schalten|,|\.|$)|^noscript: ")
SCRIPT_TALK = re.compile(r"\b(?:you can|they|test browser|switched off|turn .{1,20} off|programming|language)\b")
_STATUS = r"(?:bad gateway|not found|gateway time-?out|service (?:temporarily )?unavailable|forbidden|unauthorized|bad request|gone|too many requests|internal server error|request time-?out|method not allowed|not acceptable|conflict|moved permanently)"
STATUS = re.compile(rf"^(?:(?:http(?:/[\d.]+)?|error|fehler|erreur|erro|status(?: code)?|ошибка|エラー)?:?\s*)\(?0?\)?\s*[-:|–—]?\s*\(?{_STATUS}\)?(?:[\s.!(0:\-–—|]*(?:\w+[/ ]?[\d.]*|dns failure)?\)?)?$|^(?:http[/ ]*[\d.]* |(?:error|fehler|erreur|erro|ошибка|エラー)(?: code)? )0\b.{{0,3}}$|^(?:error|fehler|erreur|erro|ошибка|エラー) 0\s*[:.\-–—|]|^{_STATUS}\s+\(?0|^status:?\s+0\b|^\(?0\)?\s*[-:|–—]?\s*{_STATUS}\b(?! (?:is|are|was|errors?|for|when|on|in)\b)|^0\.? that's an error")
ERROR = re.compile("|".join([
    # access and sessions
    r"(?:\baccess|\brequest|^<x>)(?: to <x>)?(?: has been| is| was)? (?:denied|blocked|rejected)\b", r"\bpermission (?:to (?:access|view|see)|denied)\b", r"\b(?:not allowed|not authori[sz]ed|no permission) to (?:see|view|access)\b", r"\b(?:session|token|link) (?:has |have )?(?:expired|timed out)\b",
    r"\b(?:have been|you are|you were) (?:signed|logged) out\b", r"^(?:sorry, )?you have been blocked\b", r"\baccount (?:has been|is) (?:suspended|disabled|blocked)\b", r"\b(?:verify|confirm|prove)(?: that)? you(?:'re| are) (?:a |not a )?(?:human|robot)\b", r"\bchecking your browser\b", r"\bcomplete the security check\b", r"\bunusual traffic\b",
    # things that aren't there
    r"(?:<x>|\bcontent|\bvideo)\b?.{0,40}\b(?:(?:was|were|could) not (?:be )?found|can(?:'t|not| not) be found|(?:does not|doesn't) exist|no longer (?:here|available|exists?)|(?:has|have) been (?:moved|removed|deleted)|could not be (?:processed|loaded|displayed|completed|found))",
    r"^(?:(?:oops|uh-oh|whoops|hmm|sorry)[!,.]+ )?(?:we )?(?:could not|couldn't|can't|cannot|are unable to) (?:find|load|display|process|complete)\b", r"\bit took too long to (?:fetch|load|respond)\b", r"\bnot available in your (?:region|country|area)\b", r"\bunable to complete (?:your|the) request\b",
    # failures of servers
    r"\b(?:something|looks like something) went wrong\b", r"\b(?:unexpected|internal)(?: server)? error\b", r"\ban? (?:\w+ )?error (?:has )?occurred\b", r"\b(?:establishing|could not connect to|can't connect to|connecting to) (?:a|the|<x>)(?: \w+)? database\b", r"\bapplication error\b",
    r"\bdown for maintenance\b|^(?:<x> |system |server )?(?:is )?(?:currently )?under maintenance\b|\bperforming (?:some )?(?:scheduled )?maintenance\b", r"\b(?:server|service|system) is (?:too )?(?:busy|temporarily (?:down|unavailable|offline)|overloaded|down|(?:currently )?unavailable|over (?:its )?(?:quota|capacity))\b", r"<x> isn't working\b|<x> is (?:temporarily (?:down|unavailable|offline)|over (?:its )?(?:quota|capacity))",
    r"\btoo many requests\b|\b(?:exceeded|over) (?:your|the|its) (?:rate limit|quota|bandwidth|limit)\b|\bquota exceeded\b", r"\b(?:connection|request|upstream|operation)(?: has)? timed out\b", r"^invalid \S+ (?:specified|supplied|given|id)\b", r"^content-length: 0$", r"\bwe'll be back soon\b",
    # engines
    r"^(?:warning|notice|fatal error|parse error|deprecated): .*(?: on line| in <a>|undefined|call to|uncaught|<a>: )", r"^traceback \(most recent call last", r"^(?:template\w*|syntax|type|reference|uncaught \w*)error: ", r"^exception in ", r"\bclient-side exception has occurred\b", r"^uncaught \w+",
    # other languages
    r"\bseite (?:wurde )?nicht gefunden\b|\b(?:seite|adresse|datei) konnte nicht gefunden werden\b|\badresse gibt es hier nicht\b|^zugriff verweigert\b|\binterner serverfehler\b|\bsitzung ist abgelaufen\b|\bein fehler aufgetreten\b|^zeitüberschreitung\b|^wartungsarbeiten\b|\bdienst (?:antwortet nicht|ist (?:gerade |derzeit )?(?:überlastet|nicht verfügbar))",
    r"<x> introuvable\b|(?:<x>|\badresse\b).{0,30}\bn['’]existe (?:pas|plus)\b|^accès refusé\b|\berreur interne\b|\bsession a expiré\b|\berreur est survenue\b|\bservice (?:en maintenance|ne répond pas|indisponible)\b|^délai dépassé\b|^<x> en maintenance\b",
    r"\bpágina no encontrada\b|\b(?:página|dirección)\b.{0,30}\bno existe\b|^acceso denegado\b|\berror interno\b|\bsesión ha (?:caducado|expirado)\b|\bproducido un error\b|\b(?:estamos|servicio|sitio) en mantenimiento\b|\bservicio (?:no responde|está saturado|no disponible)\b|^tiempo de espera agotado\b",
    r"\bpágina não encontrada\b|\b(?:página|endereço)\b.{0,30}\bnão existe\b|^acesso negado\b|\berro interno\b|\bsess(?:ão|ao) (?:expirada|expirou)\b|\bocorreu um erro\b|\b(?:estamos|serviço) em manutenção\b|<x> em manutenção\b|\bserviço (?:não responde|está sobrecarregado|indisponível)\b|^tempo esgotado\b",
    r"страница не (?:найдена|существует)|^доступ запрещ[её]н|внутренняя ошибка|(?:сессия|сеанс) (?:ист[её]к(?:ла)?|заверш[её]н)|произошла ошибка|^технические работы|(?:сервис|сервер) (?:не отвечает|перегружен|недоступен)|^время ожидания истекло",
    r"ページ(?:が|は)見つかりません|アクセスが拒否され|エラーが発生しま|セッションの有効期限が切れ|^(?:現在)?メンテナンス中|^タイムアウトしました|サーバーが混み合って",
]))
PROMPT = re.compile("|".join([
    r"^\(?(?:please )?(?:describe|enter|insert|write|type|paste|add)(?: (?:your|the|a|an)\b)? [\w ]+ (?:here|in this box|below)\b", r"\b(?:delete|remove|replace|edit) this (?:line|text|paragraph|section|block|template)\b", r"\b(?:click|tap) (?:here )?to (?:edit|add|enter)\b", r"\b(?:edit or (?:remove|delete)|replace) (?:this|it)\b(?: text| with your\b)", r"^(?:todo|tbd|fixme)\b", r"^(?:\w+ )?template(?: 0)?\.?(?: |$)", r"^just another \w+ (?:<x>|blog)", r"^welcome to wordpress\b",
]))
UNFILLED = re.compile(r"^[\w .]{2,24}:\s*(?:undefined|null|nan|invalid date)(?:\W|$)|^(?:hi|hello|dear|hallo|hola|bonjour|olá|здравствуйте|привет|best|regards|kind regards|thanks|welcome)\W+(?:\w+\W+)?(?:undefined|null|nan)[.,!]?$|^(?:undefined|null|nan|invalid date)[.,!]?$|\b(?:null null|(?:has|have|by|about|under|in|at|on) (?:undefined|null|nan|invalid date)|(?:undefined|null|nan) (?:answers|votes|comments|replies|items|results))\b(?! (?:until|when|if|and|or|values?)\b)")
_FILL = r"(?:placeholder|dummy|sample|filler|example)"
FILLER = re.compile("|".join([
    rf"^(?:this is |these are )?(?:just |only )?(?:a |an |some )?{_FILL} (?:text|copy|paragraph|content|words|sentences?)\b(?! (?:is|are|was|helps?|used)\b)", r"^(?:your |the )?(?:text|content|title|headline|description|copy)(?: goes| comes)? here\b", r"^(?:content |text )?coming soon\b", r"\b(?:words|text|something) to fill (?:the|this) (?:box|space|page|field|gap)\b", r"\bonly stands here until\b",
    r"^platzhalter(?:text)?\b|^(?:dies ist |das ist |hier steht )?(?:ein )?(?:\w*blindtext|mustertext|platzhaltertext)\b|^hier (?:steht|kommt|könnte)\b.*\btext\b", r"^(?:ceci est |voici )?(?:un )?(?:faux texte|texte (?:de remplissage|à remplacer|factice|provisoire|d['’]exemple))\b",
    r"^(?:esto es |este es )?(?:un )?texto de (?:prueba|relleno|ejemplo)(?!\w| ayuda)|^aquí va (?:el|tu|su) texto\b", r"^(?:este é |isto é )?(?:um )?texto (?:provisório|de (?:teste|preenchimento|exemplo))\b|^insira (?:aqui )?(?:o )?(?:seu )?texto\b", r"^(?:это )?текст-(?:заполнитель|рыба)|^здесь будет (?:ваш )?текст", r"^(?:ここは|これは)?(?:ダミー|サンプル)(?:テキスト|の?文章?)|^ここに(?:テキスト|本文|文章|内容)",
]))
FIELD, LATIN_RUN, MASHED_RUN, REPEATED, PAGE = "<f>", "<latin>", "<keys>", "<repeated>", "<error page>"
_MASKED = {FIELD, LATIN_RUN, MASHED_RUN, REPEATED, PAGE}


def without_code(text: str) -> str:
    """text without code and block quotes, entities and widths resolved."""
    x = CODE.sub("\n", text)
    if "&" in x:
        x = CODE.sub("\n", html.unescape(x))
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", x))


def shown_only(x: str) -> str:
    """Of a text without code: math, links and quotations are taken out too, tags are line breaks."""
    return BREAK.sub("\n", QUOTE.sub(" § ", LINK.sub(" § ", MATH.sub(" § ", x))))


def masked(x: str) -> str:
    """Template fields, repeated words, addresses, dates, numbers and the names of scripts and things masked, case unified; line breaks stay."""
    if _MAY_HOLD.search(x):
        x = PLACEHOLDER.sub(" <f> ", x)
    x = _BLANKS.sub(" ", x.casefold())
    x = _SAME.sub(" <repeated> ", x)
    if "@" in x:
        x = _MAIL.sub(" <a> ", x)
    if "/" in x or "\\" in x:
        x = _FILE.sub(" <a> ", x)
    if "_" in x or "$" in x or "()" in x:
        x = _NAME.sub(" <a> ", x)
    if _NUMBER.search(x):
        if any(w in x for w in _STREETS):
            x = _STREET.sub(" <a> ", x)
        x = _NUMBER.sub("0", _HEX.sub("0", _DATE.sub("0:0", _NETWORK.sub(" <a> ", x))))
    if "script" in x or "js" in x or "скрипт" in x or "スクリプト" in x:
        x = _SCRIPTS.sub("<js>", x)
    return _THING.sub("<x>", x)


def tight(unit: str) -> str:
    """Spacing unified, list marks before and full stops after it taken off."""
    return _TIGHT.sub("", " ".join(unit.split())).lstrip("-*#• ").rstrip(".,!…。、！ ")


def mask(unit: str) -> str:
    """The key of a unit: masked, spacing unified."""
    return tight(masked(unit))


def units(x: str) -> Iterator[str]:
    """Paragraphs, lines and sentences (of lines and of paragraphs) of a masked text, each in full."""
    for paragraph in _PARAGRAPH.split(x):
        lines = paragraph.split("\n")
        yield paragraph
        yield from _SENTENCE.split(" ".join(paragraph.split()))
        if len(lines) > 1:
            for line in lines:
                yield line
                yield from _SENTENCE.split(line)


def run_of(key: str, seeds: bool) -> str | None:
    """What a unit that is no message is a run of: dummy Latin, keys hit at random, or one or two words again and again."""
    words = key.split()
    if len(words) >= 6 and len(set(words)) <= 2 and key.count("0") < len(words):
        return REPEATED
    if seeds and _SEED.search(key):
        words = _WORDS.findall(key)
        known = sum(w in LATIN for w in words)
        return LATIN_RUN if known >= 0.6 * len(words) or len(words) >= 3 and _LIVING.isdisjoint(words) else None
    if len(words) >= 5 and key.isascii() and (bare := key.rstrip(".")).replace(" ", "").isalpha() and _LIVING.isdisjoint(words):
        words = bare.split()
        return MASHED_RUN if sum(bool(_MASHED.search(w)) for w in words) >= max(3, 0.3 * len(words)) else None
    return None


def bare(key: str) -> bool:
    """Whether a unit could be of invented dummy words: three or more, and no frequent word of a living language."""
    return key.isascii() and key.count(" ") >= 2 and "<" not in key and "0" not in key and _LIVING.isdisjoint(words := _WORDS.findall(key)) and len(words) >= 3


def keys(text: str) -> dict[str, list[str] | None]:
    """The keys of a text: its masked units, the clauses of those that aren't talk, and what they are runs of. With those that are
    dummy Latin, or could be, come their words."""
    x = without_code(text)
    out: dict[str, list[str] | None] = {PAGE: None} if RAW_ERROR.search(x) else {}
    x = masked(shown_only(x))
    seeds = _SEED.search(x) is not None
    for u in dict.fromkeys(units(x)):
        key = tight(u)
        if key in out or not _LETTER.search(key):
            continue
        out[key] = None
        if FIELD in key and not ABOUT.search(key):
            out[FIELD] = None
        if REPEATED in key:
            out[REPEATED] = None
        if run := run_of(key, seeds):
            out.setdefault(run, None)
        if run == LATIN_RUN or not run and bare(key):
            words = sorted(set(_WORDS.findall(key)))
            if run:
                out[run] = words if out[run] is None else sorted({*out[run], *words})
            else:
                out[key] = words
        if len(parts := _CUT.split(key)) > 1:
            if not talk(key):
                for p in parts:
                    if len(p) >= 4:
                        out.setdefault(p, None)
            elif parts[0].endswith(_EMPTY):  # a salutation
                out.setdefault(parts[0], None)
    return out


def classify(key: str) -> str | None:
    """field, filler, script or error for a key that says so; a function of the key alone. Talk of such things is none."""
    if key in _MASKED:
        return {FIELD: "field", PAGE: "error"}.get(key, "filler")
    if FIELD in key:
        return None if ABOUT.search(key) else "field"
    if talk(key):
        return None
    if UNFILLED.search(key) or PROMPT.search(key):
        return "field"
    if FILLER.search(key):
        return "filler"
    if SCRIPT.search(key) and not SCRIPT_TALK.search(key):
        return "script"
    return "error" if STATUS.search(key) or ERROR.search(key) else None


def messages(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, h (its hash) and words (as keys() says) of each key of each document, once a row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out, words = [], [], []
            for i, t in enumerate(b.column(2)):
                mine = keys(t.as_py())
                rows += [i] * len(mine)
                out += mine
                words += mine.values()
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k.encode("utf-8", "replace") for k in out], pa.binary()).cast(pa.string()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "source", "key", "words"])

    d = docs.select("doc_id", F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), "text").where("length(trim(text)) > 0")
    return spread(d).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, key string, words array<string>").withColumn("h", F.xxhash64("key"))


def dummy(m: DataFrame, min_docs: int, min_sources: int) -> DataFrame:
    """doc_id, source of units that consist of dummy words only. Known dummy Latin teaches the words beside it, if they recur."""
    latin = m["key"] == LATIN_RUN
    w = m.where(latin).select("doc_id", "source", F.explode("words").alias("word"))
    n_docs = w.select("word", "doc_id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    n_sources = w.select("word", "source").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= min_sources)
    learned = small(n_docs.join(n_sources, "word").select("word"), "dummy-words")
    units = m.where(~latin & F.col("words").isNotNull()).select("doc_id", "source", "h", F.size("words").alias("all"), F.explode("words").alias("word"))
    hit = units.join(learned, "word").groupBy("doc_id", "source", "h").agg(F.count(F.lit(1)).alias("n"), F.max("all").alias("all"))
    return hit.where(F.col("n") >= F.col("all")).select("doc_id", "source").distinct()


def recurring(docs: DataFrame, min_docs: int = 3, min_sources: int = 2) -> tuple[DataFrame, DataFrame]:
    """(h, kind, docs, sources of each recurring key that the rules classify; doc_id, source, h of the documents' own such keys).

    Keys are counted by hash alone; only those that occur often enough are read as text and classified, and only of those so
    classified the different documents and sources are counted, exactly, with partial aggregation before each shuffle.
    """
    m = stage(messages(docs), "messages")
    unknown = stage(dummy(m, min_docs, min_sources).select("doc_id", "source", F.lit(LATIN_RUN).alias("key"), F.xxhash64(F.lit(LATIN_RUN)).alias("h")), "dummy")
    m = m.select("doc_id", "source", "key", "h").unionByName(unknown)
    often = small(m.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h"), "often")
    texts = m.select("h", "key").join(often, "h", "left_semi").groupBy("h").agg(F.min("key").alias("key"))

    @F.pandas_udf("string")
    def kind(key: pd.Series) -> pd.Series:
        return key.map(classify)

    told = small(texts.select("h", kind("key").alias("kind")).where("kind is not null"), "told")
    mine = stage(m.select("doc_id", "source", "h").join(told, "h"), "classified")
    n_docs = mine.select("h", "doc_id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    n_sources = mine.select("h", "source").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= min_sources)
    wide = small(told.join(n_docs, "h").join(n_sources, "h"), "wide")
    return wide, mine


def find(docs: DataFrame, min_docs: int = 3, min_sources: int = 2) -> DataFrame:
    """doc_id of each document with residue, once.

    Defined cases: null, empty and blank texts are no case; a NULL source counts as a source of its own; repeated rows of a
    doc_id count once; an empty table gives none. Every text is read whole, and no unit is left out for its length.
    """
    wide, mine = recurring(docs, min_docs, min_sources)
    return mine.join(wide.select("h"), "h", "left_semi").select("doc_id").distinct()
