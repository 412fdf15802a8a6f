import pytest

from pointlake.llm import residue as R
from .heldout import ORDINARY, RESIDUE
from pointlake.llm.sources import source_key
from pyspark.sql import functions as F

CASES = [
    "Hi {{{first_name}}},\n\nWhat helped was to restart it.", "Dear *|TOPIC|*, your post \"{!PRODUCT!}\" received a reply: #{title}", "%(POST.EXCERPT)S HAS #{TAG_LIST} ANSWERS", "Title: undefined\nTags: [Your topic], *|BODY|*",
    "It went __DATE__ while the rest stayed.", "Posted under [Your site name]", "Thanks.\n\n&lt;SUMMARY_DE&gt;", "Ｄｅａｒ {{ｎａｍｅ}}", "(Describe your problem in this box. Delete this line before posting.)\n\nSteps:\n1.", "TODO: add steps",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Text goes here. Text goes here. Text goes here.", "A real sentence.\n\nRebus trabes ipsum tantem ornat. Ipsum morina ulla.", "test test test test test test test", "Platzhaltertext, bitte austauschen.",
    "<h1>Bad Gateway</h1>\n<p>(502)</p>", "Error 502: Bad Gateway\n\nPlease try again in 709 seconds.", "HTTP/1.1 429 Too Many Requests\nContent-Length: 0", '{"status":404,"title":"token expired","ref":"8D5F1AC28807"}', "Su sesión ha caducado. Inténtelo más tarde.", "Accès refusé. (503)",
    "You need to enable Java Script to get any further.", "Please enable JavaScript to continue. Then reload.", "Schalten  Sie  Java  Script  ein,  um  diese  Seite  zu  sehen.", "<noscript>JS is disabled, nothing to show</noscript>", "JavaScriptをオンにしてから再読み込みしてください。", "Включите JavaScript.",
    "Warning: Undefined variable $x in /app/a/post.tpl on line 779",
]
NO_CASES = [
    "", "   \n", "The page http://a.test/x used to explain this; today it just answers 404.", "Have you tried it with scripts switched off?", "In Mustache-like files {{name}} escapes and {{{name}}} does not; that is the whole difference.",
    "My template file, shortened:\n\n```html\n<h1>{{ link_url }}</h1>\n{% for x in y %}\n```", "It prints \"{{title}}\" and stops.", "Our crawler gets this:\n\n> You need to enable JavaScript to continue.\n\nWhy?", "They show “Please enable JavaScript to continue.” again.",
    "Lorem ipsum is fine for a mock-up, but test it with real words before release.", "A 404 for a missing post is right, a 500 is not; fix the handler.", "    printf(\"%s\", __FILE__);\n    {{x}}", "Write $S_{2} = \\sum_{i=0}^{2} x_i$ and $\\|x\\|_1$.", "See [the notes](https://x.test/a) for details.",
    "Turn JavaScript off in the test browser, then you see what it sends.", "`{{ name }}` stays as it is.", "Older releases print 'Text goes here.' whenever it is slow.", "A plain answer in three sentences. It works. Try it.", "Export $HOME in your shell profile and start it again.",
]


def hit(text):
    return any(R.classify(k) for k in R.keys(text))


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert hit(text)


@pytest.mark.parametrize("text", NO_CASES)
def test_no_cases(text):
    assert not hit(text)


def test_wordings_the_rules_were_not_made_from():
    assert sum(map(hit, RESIDUE)) >= 0.8 * len(RESIDUE)
    assert sum(map(hit, ORDINARY)) <= 0.1 * len(ORDINARY)


def test_mask_is_one_key_for_copies():
    assert R.mask("Incident 8EE940D261AE at  2025-01-03 10:11") == R.mask("incident 1AB23CD9 at 2024-12-31 09:00")
    assert R.mask("Dear {{name}} ,") == R.mask("Dear *|TOPIC|*,") == "dear <f>"
    assert R.mask("Contact admin@site-a.org now") == R.mask("contact root@example.com  now")
    assert R.mask("From 10.0.0.1, 12 Long Oak Street") == R.mask("From 192.168.7.12, 7 Elm Street")
    assert R.mask("Turn on JavaScript") == R.mask("turn on scripts") and R.mask("in /srv/a/x.tpl on line 3") == R.mask("in /var/www/y.php on line 77")


def copies(text, n=3):
    return [(i + 1, f"s{i % 2}", text) for i in range(n)]


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "'x' as key", "0 as h", "'y' as words")
    return sorted(r["doc_id"] for r in R.find(docs, **how).collect())


def test_only_what_recurs_is_found(spark):
    rows = copies("A fine text.\n\nHi {{name}}!\n\nMore of it.") + [(4, " S1", "Welcome, *|TOPIC|*"), (5, "s9", None), (6, None, ""), (7, "s1", "Another fine text."), (4, " S1", "Welcome, *|TOPIC|*")]
    assert found(spark, rows) == [1, 2, 3, 4]  # fields are one key, whatever their names and styles
    assert found(spark, rows, min_docs=5) == [] and found(spark, rows, min_sources=3) == []
    assert found(spark, copies("Access denied.", 2)) == [] and found(spark, copies("Access denied.")[:2] + [(3, "s0", "It works. ACCESS  DENIED.")]) == [1, 2, 3]
    assert found(spark, [(i, "s0", "Access denied.") for i in range(5)]) == []  # one source
    assert found(spark, [(i, None if i else "a", "Access denied.") for i in range(3)]) == [0, 1, 2]  # NULL is a source of its own
    assert found(spark, [(1, f"s{i}", "Access denied.") for i in range(5)]) == []  # one document
    assert found(spark, copies("It took me some time.", 50)) == [] and found(spark, copies("x")[:0]) == []


def test_units_of_any_length(spark):
    contact = "(contact " + "the administrator of the site and quote the number " * 40 + ")"
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate([f"Access denied {contact}", "Access denied.", "Access denied", "word " * 100_000 + "\n\nAccess denied.", "Ordinary " + "words of a long line " * 5000 + ". Access denied. " + "And more words " * 5000])]
    assert found(spark, rows) == [0, 1, 2, 3, 4]


def test_dummy_words_are_learned(spark):
    seeded = [(i, f"s{i % 3}", f"Lorem borkum ipsum {a} trelvan dolor.") for i, a in enumerate(["quintar", "plonis", "quintar", "plonis", "plonis", "quintar"])]
    rows = [*seeded, (10, "s0", "A text.\n\nBorkum plonis trelvan quintar."), (11, "s1", "Borkum plonis house quintar.")]
    assert found(spark, rows) == [0, 1, 2, 3, 4, 5, 10]


def test_sources(spark):
    df = spark.createDataFrame([(" Forge_QA ",), ("forge_qa",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(F.col("s"))).collect()] == ["forge_qa", "forge_qa", None, None]


def test_first_sentence_of_a_long_line_after_an_unterminated_one():
    assert hit("Notice\nYou need to enable JavaScript to get any further. " + "The rest of this line is an ordinary text. " * 8)


@pytest.mark.parametrize("mark", "。！？")
def test_japanese_sentences_without_spaces(mark):
    assert hit(f"この手順は前の版で確認しました{mark}JavaScriptを有効にしてください。")
    assert not hit(f"この手順は前の版で確認しました{mark}次の版でも同じです。")


def test_keys_at_the_threshold_are_counted_exactly(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    rows = [(3 * i + j, f"s{(i + j // 2 * 7919) % 9973}", f"Invalid {word(i)} specified") for i in range(6000) for j in range(3)]
    found = R.find(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    assert found.count() == len(rows)
    wide, _ = R.recurring(spark.createDataFrame(rows[:2] + rows[3:], "doc_id bigint, source string, text string"))
    assert wide.count() == 5999 and {(r["docs"], r["sources"], r["kind"]) for r in wide.collect()} == {(3, 2, "error")}
