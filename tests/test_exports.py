"""Export parsers on one sample of each format, and on damaged ones."""

import pytest

from corvina.sources import exports
from corvina.sources.exports import Rejection, parse

RIS = """TY  - JOUR
AU  - Nowak, Anna
AU  - Smith, J.
TI  - First study of sleep
T2  - Journal One
PY  - 2020/05/01
VL  - 12
IS  - 3
SP  - 10
EP  - 19
DO  - 10.1000/one
AN  - PMID 12345678
DB  - Embase
M3  - Review
KW  - sleep
KW  - memory
ER  -

TY  - CHAP
TI  - Second study
 that goes on
PY  - 2019
AN  - L601234567
ER  -
"""
WOS = """FN Clarivate Analytics Web of Science
VR 1.0
PT J
AU Nowak, A
   Smith, J
AF Nowak, Anna
   Smith, John
TI First study
   of sleep
SO JOURNAL ONE
DT Article
DE sleep; memory
DI 10.1000/one
PY 2020
VL 12
IS 3
BP 10
EP 19
TC 7
PM 12345678
UT WOS:000123
CR Doe J, 2001, J TWO
   Roe R, 2002, J THREE
ER

PT J
TI Second study
PY 2019
UT WOS:000124
ER

EF
"""
NBIB = """PMID- 12345678
DP  - 2020 May
TI  - First study of sleep and
      memory in adults.
PG  - 10-9
AB  - Some text.
FAU - Nowak, Anna
AU  - Nowak A
JT  - Journal One
VI  - 12
IP  - 3
LA  - eng
PT  - Journal Article
MH  - *Sleep*
AID - 10.1000/one [doi]
IS  - 1234-5678 (Print)

PMID- 12345679
TI  - Second study
PT  - Review
"""
BIBTEX = r"""@string{jone = "Journal One"}
@comment{ignored}
@article{nowak2020,
  author = {Nowak, Anna and {World Health Organization} and G{\"o}del, Kurt},
  title = {First {S}tudy of \emph{sleep} in {\L}{\'o}d{\'z} \& beyond: 5\% more},
  journal = jone # { (Print)},
  year = 2020, volume = {12}, number = "3", pages = {10--19},
  keywords = {sleep; memory}, doi = {10.1000/one}, note = {PMID: 12345678. Cited by: 7}
}
@inproceedings{smith2019, title = "Second {"}study{"}", booktitle = {Proc. of Things}, year = {2019}, author = {John Smith}}
"""
ENDNOTE = """<?xml version="1.0"?><xml><records><record><ref-type name="Journal Article">17</ref-type><contributors><authors><author><style>Nowak, Anna</style></author><author>John Smith</author></authors></contributors><titles><title><style>First study of </style><style face="italic">sleep</style></title><secondary-title>Journal One</secondary-title></titles><pages>10-19</pages><volume>12</volume><dates><year>2020</year></dates><electronic-resource-num>doi:10.1000/one</electronic-resource-num><accession-num>12345678</accession-num><keywords><keyword>sleep</keyword><keyword>memory</keyword></keywords></record><record><ref-type name="Thesis">32</ref-type><titles><title>Second study</title></titles></record></records></xml>"""
ENW = """%0 Journal Article
%A Nowak, Anna
%A Smith, John
%T First study of sleep
%J Journal One
%D 2020
%V 12
%N 3
%P 10-19
%R 10.1000/one
%@ 1234-5678
%M 12345678
%K sleep; memory
%X An abstract
that wraps

%0 Conference Paper
%T Second study
%D 2019
"""
SCOPUS = '''"Authors","Title","Year","Source title","Volume","Issue","Page start","Page end","Cited by","DOI","Link","Author Keywords","Index Keywords","Document Type","EID","Open Access"
"Nowak A.; Smith J.","First study, of ""sleep""
and memory",2020,"Journal One",12,3,10,19,7,"10.1000/one","https://x.org","sleep; memory","Sleep; brain","Article","2-s2.0-1","All Open Access, Gold"
"Smith J.","Second study",2019,"Journal Two",,,,,,,,,,"Conference Paper","record:sha1:ab",""
'''
HTML = "<html><body><table><tr><td><table><tr><th>Title</th><th>Authors</th><th>Publication year</th><th>StoreId</th></tr><tr><td>First study<br>of sleep</td><td>Nowak, Anna; Smith, John</td><td>2020</td><td>77</td></tr><tr><td>Second &amp; last</td><td>Smith</td></tr></table></td></tr></table></body></html>"
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2001.00001v2</id><title>First
 study</title><summary>Text</summary><author><name>Anna Nowak</name></author><author><name>Ludwig van Beethoven</name></author><published>2020-01-02T00:00:00Z</published><arxiv:doi>10.1000/one</arxiv:doi><arxiv:primary_category term="cs.DB"/><category term="cs.IR"/><category term="cs.DB"/><link rel="alternate" href="http://arxiv.org/abs/2001.00001"/></entry><entry><id>http://arxiv.org/abs/2001.00002</id><title>Second</title></entry></feed>"""
PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>12345678</PMID><Article><Journal><ISSN>1234-5678</ISSN><JournalIssue><Volume>12</Volume><Issue>3</Issue><PubDate><MedlineDate>2020 May-Jun</MedlineDate></PubDate></JournalIssue><Title>Journal One</Title></Journal><ArticleTitle>First <i>study</i> of sleep</ArticleTitle><Pagination><MedlinePgn>10-9</MedlinePgn></Pagination><ELocationID EIdType="doi">10.1000/one</ELocationID><Abstract><AbstractText Label="AIM">Why.</AbstractText><AbstractText>How.</AbstractText></Abstract><AuthorList><Author><LastName>Nowak</LastName><ForeName>Anna</ForeName></Author><Author><CollectiveName>A Group</CollectiveName></Author></AuthorList><Language>eng</Language><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><KeywordList><Keyword>sleep</Keyword></KeywordList></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>Second</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
SAMPLES = {"ris": RIS, "wos": WOS, "nbib": NBIB, "bibtex": BIBTEX, "endnote": ENDNOTE, "enw": ENW, "csv": SCOPUS, "html": HTML, "atom": ATOM, "pubmed": PUBMED}


@pytest.mark.parametrize("name", SAMPLES)
def test_sample(name):
    assert exports.detect_format(SAMPLES[name]) == name
    found = parse(SAMPLES[name])
    assert len(found) == 2 and all(isinstance(x, dict) for x in found)
    first, second = found
    assert first["title"].startswith("First") and second["title"].startswith("Second")
    assert first["year"] == 2020
    if name != "html":
        assert "10.1000/one" in first["doi"]
    if name not in ("html", "atom"):
        assert first["volume"] == "12" and first["pages"] in ("10-19", "10-9")
        assert first.get("pmid") in ("12345678", "", "PMID 12345678") and first["journal"].lower().startswith("journal one")
    assert first["authors"][0] in ("Nowak, Anna", "Nowak, A.")


def test_details():
    first, second = parse(RIS)
    assert (first["doc_type"], first["pmid"], first["keywords"]) == ("review", "12345678", ["sleep", "memory"])
    assert (second["title"], second["source_id"], second["doc_type"]) == ("Second study that goes on", "L601234567", "chapter")
    first, _ = parse(WOS)
    assert first["title"] == "First study of sleep" and first["references"] == ["Doe J, 2001, J TWO", "Roe R, 2002, J THREE"] and first["cited_by"] == 7 and first["authors"] == ["Nowak, Anna", "Smith, John"]
    first, second = parse(NBIB)
    assert first["keywords"] == ["*Sleep"] and second["doc_type"] == "review" and first["title"].endswith("in adults.")
    first, second = parse(BIBTEX)
    assert first["title"] == "First Study of sleep in Łódź & beyond: 5% more" and first["journal"] == "Journal One (Print)" and first["cited_by"] == 7
    assert first["authors"][0] == "Nowak, Anna" and first["authors"][2] == "Gödel, Kurt" and second["authors"] == ["Smith, John"] and second["doc_type"] == "conference"
    first, second = parse(ENDNOTE)
    assert first["title"] == "First study of sleep" and first["authors"] == ["Nowak, Anna", "Smith, John"] and second["doc_type"] == "thesis"
    first, second = parse(ENW)
    assert first["issn"] == "1234-5678" and first["abstract"] == "An abstract that wraps" and second["doc_type"] == "conference"
    first, second = parse(SCOPUS)
    assert first["title"] == 'First study, of "sleep" and memory' and first["authors"] == ["Nowak, A.", "Smith, J."] and first["keywords"] == ["sleep", "memory", "brain"]
    assert (first["scopus_id"], first["open_access"], first["cited_by"], second["scopus_id"], second["source_id"]) == ("2-s2.0-1", True, 7, "", "record:sha1:ab")
    first, second = parse(HTML)
    assert first["title"] == "First study of sleep" and second["title"] == "Second & last" and first["source_id"] == "77"
    first, _ = parse(ATOM)
    assert first["keywords"] == ["cs.DB", "cs.IR"] and first["authors"] == ["Nowak, Anna", "van Beethoven, Ludwig"] and first["source_id"] == "2001.00001"
    first, _ = parse(PUBMED)
    assert first["abstract"] == "AIM: Why. How." and first["authors"] == ["Nowak, Anna", "A Group"] and first["title"] == "First study of sleep" and first["doc_type"] == "review"


DAMAGE = {
    "empty": lambda t: "", "blank": lambda t: " \n\t\n", "half": lambda t: t[: len(t) // 2], "quarter": lambda t: t[: len(t) // 4], "one": lambda t: t[:1],
    "crlf": lambda t: t.replace("\n", "\r\n"), "cr": lambda t: t.replace("\n", "\r"), "no end": lambda t: t.rstrip(), "bom": lambda t: "﻿" + t, "nul": lambda t: t[:50] + "\0" + t[50:],
    "long": lambda t: t.replace("First", "First " + "x" * 200_000), "twice": lambda t: t + "\n" + t, "garbage": lambda t: "\x01\x02" * 300 + t, "page": lambda t: "<html><body>not found</body></html>",
    "json": lambda t: '{"a": 1}', "marks": lambda t: ",,,,\n;;;;\n", "header": lambda t: t.split("\n")[0], "tags": lambda t: "TY  - \nER  - \n", "braces": lambda t: t.replace("}", ""),
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("damage", DAMAGE)
def test_damage(name, damage):
    data = DAMAGE[damage](SAMPLES[name]).encode()
    text, _, kind = exports.decoded(data)
    for fmt in ("auto", name):
        found = parse(text, fmt)
        assert all(isinstance(x, dict) or x.reason in exports.REASONS for x in found)
        if damage in ("crlf", "cr", "no end", "bom", "long"):
            assert sum(isinstance(x, dict) for x in found) == 2, (fmt, found)
    assert not kind or damage == "garbage"


def test_truncated_xml():
    found = parse(ENDNOTE[: ENDNOTE.index("Second")], "endnote")
    assert isinstance(found[0], dict) and found[1:] == [Rejection("truncated", "the document ends inside an element")]


def test_encodings():
    text = RIS.replace("Nowak", "Nowák").replace("First", "Łódź First")
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"):
        assert exports.decoded(text.encode(name))[0] == text, name
    assert exports.decoded("é".encode("cp1252") + b" x")[:2] == ("é x", "cp1252")
    assert exports.decoded(b"%PDF-1.4")[2] == "PDF" and exports.decoded(b"\x01\x02\x03" * 100)[2] == "binary"


def test_read_exports(spark, tmp_path):
    for name, text in SAMPLES.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode("utf-16" if name == "wos" else "utf-8"))
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 \x00\x01")
    out = exports.read_exports(spark, str(tmp_path)).cache()
    for r in exports.accounts(out).collect():
        assert r["seen"] == r["accepted"] + sum(r[x] for x in exports.REASONS)
        assert r["accepted"] == (0 if r["path"].endswith("pdf") else 2)
    records = exports.records_of(out).orderBy("ord").collect()
    assert [r["ord"] for r in records] == list(range(20))
    assert {r["doi"] for r in records} == {"", "10.1000/one"}


def test_round_trip(spark, tmp_path):
    """What the exports write, the parsers read back."""
    from corvina.operators import export
    from corvina.schema import conform

    rows = [(0, "R000001", "Of {Braces} & 50% ~ more_or_less", "Some text", "J One", "10.1000/a", 2001, "3", "1-9", "article", ["Nowak, Anna", "Smith, J."], ["risk", "care"]), (1, "R000002", "=Plain", "", "Proc", "", None, "", "e12", "conference", [], [])]
    records = conform(spark.createDataFrame(rows, "ord long, uid string, title string, abstract string, journal string, doi string, year int, volume string, pages string, doc_type string, authors array<string>, keywords array<string>"))
    texts = {"ris": "\n".join(r[0] for r in records.orderBy("ord").select(export.ris_text()).collect()), "bibtex": "\n\n".join(r["text"] for r in export.bibtex_frame(records).orderBy("ord").collect())}
    for fmt, text in texts.items():
        first, second = parse(text, fmt)
        for c in ("title", "abstract", "journal", "doi", "year", "volume", "pages", "doc_type", "authors", "keywords"):
            assert first[c] == records.orderBy("ord").first()[c], (fmt, c)
        assert second["doc_type"] == "conference" and second["title"] == "=Plain"
    export.write_csv(export.scopus_frame(records), f"{tmp_path}/csv", one_file=True)
    (file,) = list((tmp_path / "csv").glob("*.csv"))
    first, second = parse(file.read_text(), "csv")
    assert first["title"] == rows[0][2] and first["pages"] == "1-9" and first["authors"] == rows[0][10] and second["title"] == "'=Plain" and second["source_id"].startswith("record:sha1:")
