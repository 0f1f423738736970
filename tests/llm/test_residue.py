from collections import Counter

import pyarrow.parquet as pq
import pytest

from quiverlane.llm import exemplars, latex, residue
from tests.llm import wordings

ARTICLE = r"""\documentclass{article}
\usepackage{lipsum}
\newcommand{\todo}[1]{\textcolor{red}{#1}}
\newcommand{\filler}{\lipsum[1]}
\title{%s}
\author{A. Nother \and B. Other}
\begin{document}
\maketitle
\begin{abstract}
We study slow operators on thin lattices and bound their spectrum.
\end{abstract}
\section{Introduction}
Let $x_{3}$ be the title of the article, so that ${{a}}_{3}$ and $[[P_{2}]]$ agree~\cite{abc}.

%s

\begin{table}\begin{tabular}{lr}
kernel & 0.1 \\ kernel & 0.2 \\ kernel & 0.3 \\
\end{tabular}\caption{Kernels.}\end{table}
It remains open whether this holds.
\end{document}
"""


@pytest.fixture(scope="module")
def index():
    common = {w: 900 for w in "the of a in title abstract section this is to be and for we that on".split()}
    return residue.Index(common, 1000)


def found(index, text):
    plain = latex.unescaped(text)
    matches = list(index.matches(plain))
    assert not matches or index.may_match(plain)
    return {m[0] for m in matches}


def article(paragraph, title="Slow operators on thin lattices"):
    return ARTICLE % (title, paragraph)


@pytest.mark.parametrize("label, text", [(k, t) for lines in (exemplars.EXEMPLARS, exemplars.GIVEN) for k, v in lines.items() for t in v.strip().splitlines()])
def test_each_exemplar_is_found(index, label, text):
    source = text.replace("_", r"\_").replace("#", r"\#")
    for variant in (source, source.upper(), source.replace(" ", "~"), source.replace(" ", "\n"), r"\textbf{" + source + "}", "\\begin{center}\n" + source + "\n\\end{center}"):
        assert found(index, article(variant)), variant


@pytest.mark.parametrize(
    "text",
    [
        r"\lipsum[1-3]", r"\blindtext", r"\Blindtext[4]", r"\kant[9]", "Please enable Java\\-Script to view this resource.", "The requested paper was not found on this server.", "Error 503: page not found. Go back to the resource list.",
        r"$\{article\_title\}".replace("$", r"\$"), "@@ABSTRACT@@", r"\%TITLE\%", r"\_\_DOC\_TITLE\_\_", "{{ sections[3].body }}", "[[SECTION_258_BODY]]", r"\textless{}title\textgreater{}", "<TITLE>", "[object Object]", r"Dear \{\{AUTHOR\_NAME\}\}, your text belongs here.",
        "Bla, bla, bla, bla, bla, bla.", "Text text text text text text.", "Ceci est un faux texte. Ceci est un faux texte. Ceci est un faux texte.", "This goes on. This goes on. This goes on. This goes on.",
        "Lorem ipsum dolor sit amet, cursus velit orci mauris.", "Vitae orci diam ipsum urna elit lorem mollis massa vitae.",
        "Your browser has cookies and scripts disabled. Switch them on and reload this site to view the document.", "It works. 404 Not Found", "<html><head><title>403 Forbidden</title></head><body><h1>403 Forbidden</h1><hr></body></html>", '{"error":{"code":500,"message":"page unavailable"}}',
    ],
)
def test_found(index, text):
    assert found(index, article(text))


@pytest.mark.parametrize("title", ["{{ paper.title }}", "Your Paper Title", "TYPE YOUR TITLE", "<title>", "[Title of the Article]", "Escriba aqu\\'i el t\\'itulo"])
def test_found_in_titles(index, title):
    assert found(index, article("Nothing here.", title))


@pytest.mark.parametrize(
    "text",
    [
        "Nothing here.", "% Please enable JavaScript to view this article.", "\\begin{comment}\n404 Not Found\n\\end{comment}", "\\iffalse\nLorem ipsum dolor sit amet, cursus velit orci mauris.\n\\fi",
        "Of 71 archived links, 27 now answer with ``please enable JavaScript''.", r"The string ``404 Not Found'' was removed from the crawl, as was \verb|{{title}}|.", r"The template slot \verb|{{title}}| is replaced at build time, so is \verb|${author}|.",
        r"A classifier trained on pages such as \texttt{you need to enable JavaScript to run this app} reaches 93\,\% precision.", r"We call a response soft-failing if it says \emph{lorem ipsum} but has status 200.", "The warning “Internal Server Error” stood in 210 of the 86414 logs.",
        "\\begin{lstlisting}\nHello {{user}}, you have {{n}} mails.\n\\end{lstlisting}", "\\begin{verbatim}\n<h1>{{ page.title }}</h1>\n\\end{verbatim}", r"\input{sections/missing}", r"\includegraphics{missing}", r"\newcommand{\x}{\blindtext}",
        "The title of the paper was changed by the author.", "Our server answered each request within 3 s.", "This is very, very good.", "The abstract should be read with care.", "Scripts and cookies are studied in Section 3.",
    ],
)
def test_no_case(index, text):
    assert not found(index, article(text))


@pytest.mark.parametrize("text", ["", " ", "\n\n", r"\include{chapters/a}", r"\section{Outlook} A short fragment.", "$x$", "{", "}", "\\", "%", "``", r"\begin{verbatim}", "{{", "x" * 200_000, "\\textbf{" * 500])
def test_fragments(index, text):
    assert not found(index, text)


def test_whole_text_is_an_error_page(index):
    assert found(index, "Access denied. You do not have permission to view this page (code 7b97d2d7).") == {"error"}
    assert found(index, "\r\nBitte aktivieren Sie JavaScript,\r\num den Artikel zu lesen.\r\n") == {"notice"}


def test_over_a_table(spark):
    rows = [(1, article("404 Not Found"), "a"), (1, article("404 Not Found"), "a"), (2, article("Nothing here."), "b"), (3, None, "c"), (4, "", "d"), (5, article(r"\lipsum"), "e"), (None, "Bad Gateway", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    assert sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").where("doc_id is not null").collect()) == [1, 5]
    assert residue.residue_matches(df, "doc_id", "text").where("doc_id = 1").count() == 2
    kept = residue.without_residue(df, "doc_id", "text")
    assert kept.columns == ["doc_id", "text", "label"] and sorted(r.doc_id or 0 for r in kept.collect()) in ([0, 2, 3, 4], [2, 3, 4])
    assert residue.residue_documents(df.limit(0), "doc_id", "text").collect() == []


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


def test_filler_in_a_third_of_all_rows_and_in_one(spark):
    rows = [(i, article(LOREM if i % 3 == 0 else "Tempor magna sed elit dolore ut labore." if i == 1 else "Nothing here.")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()) == sorted([1, *range(0, 30, 3)])
    one = spark.createDataFrame([(1, LOREM)], "doc_id long, text string")
    assert [r.doc_id for r in residue.residue_documents(one, "doc_id", "text").collect()] == [1]
    assert residue.residue_documents(spark.createDataFrame([(1, article("Nothing here."))], "doc_id long, text string"), "doc_id", "text").collect() == []


@pytest.mark.parametrize("text", ["Xxx xxx xxx xxx xxx xxx.", "Xxx, xxx, xxx, xxx, xxx.", "Bla, bla, bla, bla, bla, bla.", "Text text text text text text.", "Xx yy xx yy xx yy.", "Xxx xxx. Xxx xxx. Xxx xxx.", "Ceci est un faux texte. Ceci est un faux texte. Ceci est un faux texte."])
def test_repeated_words_in_capitals(index, text):
    for variant in (text, text.upper()):
        assert found(index, article(variant)) == {"filler"}, variant
        assert found(index, variant) == {"filler"}, variant


@pytest.mark.parametrize("text", ["1 1 1 1 1 1", "12 34 12 34 12 34", "Kernel & XX \\\\ XX & XX & XX & XX", "The case XXX is the case XX."])
def test_no_repeated_words(index, text):
    assert not found(index, article(text))


@pytest.mark.parametrize("text", [r"Accepted by \{\{journal.name\}\} following careful revision.", "Accepted by {{journal.name}} following careful revision.", "The manuscript that @@AUTHOR@@ sent was received with great delay.", r"Readers of \_\_DOC\_TITLE\_\_ may find further results elsewhere.", r"Submitted with delay by \$\{author\} following careful revision."])
def test_slots_inside_sentences(index, text):
    assert found(index, article(text)) == {"placeholder"}


@pytest.mark.parametrize("text", [r"This is the {{\bf main}} result of our careful analysis.", "Air with 5\\%CO2 was used, see [Table 3] for further measurements.", r"The slot \verb|{{journal.name}}| and ``@@AUTHOR@@'' are replaced during careful revision."])
def test_no_slots_inside_sentences(index, text):
    assert not found(index, article(text))


def test_rows_without_a_key(spark):
    rows = [(None, article("404 Not Found"), "a"), (None, article("Nothing here."), "b"), (1, article("404 Not Found"), "c"), (2, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = residue.without_residue(df, "doc_id", "text")
    assert kept.schema == df.schema and sorted(r.label for r in kept.collect()) == ["b", "d"]


@pytest.fixture(scope="module")
def of_documents(data):
    """Indexes with the frequencies of documents: of all exemplars, and of those that aren't from the given tables."""
    texts = [latex.unescaped(t) for t in pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist() if t is not None]
    known = residue._Known(frozenset(w for e in residue.bank() for w in e.bag))
    frequency = Counter(w for t in texts for w in residue.prose_terms(t, known))
    return texts, residue.Index(frequency, len(texts)), residue.Index(frequency, len(texts), residue.bank(exemplars.EXEMPLARS))


def part_found(index, wordings):
    lines = [line for block in wordings.values() for line in block.strip().splitlines()]
    return sum(bool(found(index, article(line))) for line in lines) / len(lines)


def test_recall_on_new_wordings(of_documents):
    _, index, own = of_documents
    assert part_found(index, wordings.DEVELOPMENT) > 0.9 and part_found(index, wordings.REVISED) > 0.9
    assert part_found(index, wordings.HELD_OUT) > 0.75 and part_found(own, wordings.HELD_OUT) > 0.72


def test_recall_on_the_wordings_of_the_given_tables(of_documents):
    texts, index, own = of_documents
    assert part_found(index, exemplars.GIVEN) == 1.0 and part_found(own, exemplars.GIVEN) > 0.75
    assert all(list(index.matches(t)) for t in texts if list(own.matches(t)))


def test_precision_on_sentences_of_articles(of_documents):
    sentences = wordings.ARTICLE_SENTENCES.strip().splitlines()
    assert sum(bool(found(of_documents[1], article(s))) for s in sentences) <= 2


@pytest.mark.parametrize("title", ["Your Paper Title", "Please enable JavaScript to view this article.", "404 Not Found", "Hier fügen Sie bitte Ihren Text ein."])
def test_residue_in_a_third_of_all_rows_and_in_one(spark, title):
    df = spark.createDataFrame([(i, article("Nothing here.", title if i % 3 == 0 else "Slow operators")) for i in range(30)], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()) == list(range(0, 30, 3))
    assert residue.residue_documents(df.where("doc_id = 3"), "doc_id", "text").count() == 1


@pytest.mark.parametrize("text", ["Titre S. Dripol. Membrane: random beam. Proc. Guglas 58 (2010), 143--689.", "Fatal M. Broplis. Gohoupais: lokale Verlauf.", "The title of the paper was changed by the author."])
def test_names_that_are_words(of_documents, text):
    assert not found(of_documents[1], article(text))
