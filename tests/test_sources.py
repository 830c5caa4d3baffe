import io
import struct
import zipfile

import pandas as pd
import pytest

from tracewell.sources import files as S
from tracewell.sources import providers as P


def cells(content, **k):
    return [(c["row_index"], c["column_index"], c["decoded"], content[c["start_byte"] : c["end_byte"]].decode()) for c in S.delimited_cells(content, **k)]


def test_delimited_spans():
    content = b'name,value,note\r\nA,"1,5","x\ny"\r\nB,,""\r\n'
    got = cells(content)
    assert len(got) == 9 and got[4][2:] == ("1,5", '"1,5"') and got[5][2] == "x\ny" and got[7][2] == "" and got[8][2:] == ("", '""')


def test_byte_order_mark_and_tabs():
    got = list(S.delimited_cells(b'\xef\xbb\xbfobject\tcomment\nx\t"a ""b"""\n', "\t"))
    assert got[0]["start_byte"] == 3 and got[3]["decoded"] == 'a "b"'


@pytest.mark.parametrize("bad", [b"a,b\nc\n", b'a,"b\n', b'a,b"c\n', b'"a"b,c\n', b"a,\xff\n", b""])
def test_malformed(bad):
    with pytest.raises(S.ParseError):
        list(S.delimited_cells(bad))


def test_limits():
    for limits in (S.TableLimits(max_rows=1), S.TableLimits(max_columns=1), S.TableLimits(max_cells=3), S.TableLimits(max_cell_bytes=1), S.TableLimits(max_bytes=5)):
        with pytest.raises(S.ParseError, match="limit_exceeded"):
            list(S.delimited_cells(b"aa,b\nc,d\n", limits=limits))


def test_trailing_delimiter_is_an_empty_cell():
    assert [c["decoded"] for c in S.delimited_cells(b"a,b\nc,")] == ["a", "b", "c", ""]
    assert [c["decoded"] for c in S.delimited_cells(b"a,\nc,d\n")] == ["a", "", "c", "d"]


def test_json_lexemes():
    got = [(c["header"], c["value_json"]) for c in S.json_records(b'[{"time":1.20,"flag":true,"note":" x "},{"time":2,"flag":false}]')]
    assert got == [("time", "1.20"), ("flag", "true"), ("note", '" x "'), ("time", "2"), ("flag", "false"), ("note", "null")]
    assert [c["value_json"] for c in S.json_records(b'{"type":"FeatureCollection","features":[{"properties":{"a":1}}]}')] == ["1"]
    for bad in (b"{}", b"[]", b"[1]", b'[{"a":NaN}]', b'[{"a":[1]}]', b"{", b'[{"a":"' + b"x" * 8193 + b'"}]'):
        with pytest.raises(S.ParseError):
            list(S.json_records(bad))


def test_preview():
    assert [(c["value_json"], c["location"]) for c in S.delimited_preview(b"name,flux\na, x \n")] == [('"a"', 2), ('" x "', 2)]
    for bad in (b"a,a\n1,2\n", b"a,b\n1\n", b""):
        with pytest.raises(S.ParseError):
            list(S.delimited_preview(bad))


def test_paragraphs():
    got = [(b["text"], b["start_byte"], b["end_byte"]) for b in S.paragraphs(b"a\r\nb\r\n \r\n\r\nc")]
    assert got == [("a\r\nb", 0, 4), ("c", 11, 12)]
    assert list(S.paragraphs(b"")) == []


def test_html():
    html = "<html><head><title>T</title><script>x</script></head><body><h1>A &amp; B</h1><p>one <b>two</b></p><ul><li>i</li></ul><pre>c</pre></body>"
    assert S.html_blocks(html) == [("paragraph", "T"), ("heading", "A & B"), ("paragraph", "one two"), ("list_item", "i"), ("code", "c")]
    assert S.html_blocks("") == []


def test_files_fail_one_by_one(spark):
    df = spark.createDataFrame([("a", bytearray(b"x,y\n")), ("b", bytearray(b'"')), ("c", None)], "path string, content binary")
    got = {(r.path, r.failure, r.decoded) for r in S.parse_files(df, S.delimited_cells, S.CELLS).collect()}
    assert got == {("a", None, "x"), ("a", None, "y"), ("b", "invalid_structure", None), ("c", "limit_exceeded", None)}


def test_small_files_share_a_frame(monkeypatch):
    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    run = S.parse_files(Files(), S.json_records, S.PREVIEW)
    files = pd.DataFrame({"path": [str(i) for i in range(1000)], "content": [b"?" if i == 7 else b'[{"k": %d}]' % i for i in range(1000)]})
    frames = list(run(iter([files[:500], files[500:]])))
    assert len(frames) == 1 and len(frames[0]) == 1000
    assert frames[0].failure[7] == "invalid_structure" and frames[0].failure.notna().sum() == 1 and frames[0].value_json[8] == "8"
    monkeypatch.setattr(S, "FRAME_ROWS", 100)
    assert [len(f) for f in run(iter([files]))] == [100] * 10 and list(run(iter([files[:0]]))) == []


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_zip():
    assert [(m["name"], m["size"]) for m in S.zip_members(archive(**{"a.csv": b"1", "d/b.txt": b"22"}))] == [("a.csv", 1), ("d/b.txt", 2)]
    for bad in (archive(**{"../x": b""}), archive(**{"/x": b""}), archive(**{"a": b"", "A": b""}), archive(a=b"0" * 100_000), b"PK"):
        with pytest.raises(S.ParseError):
            list(S.zip_members(bad))


def scatter():
    pixels = bytearray(b"\xff" * (64 * 64 * 3))
    for x, y in ((10, 30), (30, 20), (50, 40)):
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                at = ((y + dy) * 64 + x + dx) * 3
                pixels[at : at + 3] = bytes((220, 20, 60))
    return b"P6\n# made here\n64 64\n255\n" + bytes(pixels)


def test_ppm():
    got = list(S.ppm_components(scatter(), (220, 20, 60), 5, 4))
    assert [(c["x"], c["y"], c["pixels"]) for c in got] == [(30, 20, 9), (10, 30, 9), (50, 40, 9)]
    with pytest.raises(S.ParseError):
        S.ppm_pixels(scatter()[:-1])


def card(key, value=None):
    return (f"{key:<8}" + (f"= {value:>20}" if value is not None else "")).ljust(80).encode()


def light_curve():
    def block(cards, data=b""):
        head = b"".join([*cards, card("END")])
        return head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")

    rows = b"".join(struct.pack(">dhf", *r) for r in ((59000, 125, 0.05), (59001.5, 150, 0.04), (59003, 200, float("nan")), (59004.5, 275, 0.08)))
    columns = (("MJD", "D"), ("MAG", "I"), ("MAG_ERR", "E"))
    named = [c for i, (n, f) in enumerate(columns, 1) for c in (card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{f}'"))]
    table = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 14), card("NAXIS2", 4), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3), *named, card("TSCAL2", "0.01"), card("TZERO2", "10")]
    return block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(table, rows)


def test_fits():
    got = list(S.fits_table(light_curve()))
    assert len(got) == 12 and sum(c["kind"] == "missing" for c in got) == 1
    mag = [(c["raw_value"], c["physical_value"]) for c in got if c["variable"] == "MAG"]
    assert mag == [("125", "11.25"), ("150", "11.5"), ("200", "12"), ("275", "12.75")]
    assert len(list(S.fits_table(light_curve(), ["MJD"], 1, 3))) == 2


def test_media(spark):
    from pyspark.sql import functions as F

    rows = [(0, bytearray(b"%PDF-1.7")), (1, bytearray(b"PAR1xxxxPAR1")), (2, bytearray(b"PK\x03\x04..")), (3, bytearray(b"hello"))]
    df = spark.createDataFrame(rows, "i int, c binary").orderBy("i")
    assert [r[0] for r in df.select(S.magic(F.col("c"))).collect()] == ["application/pdf", "application/vnd.apache.parquet", "application/zip", None]
    texts = spark.createDataFrame([(0, " <HTML>"), (1, '{"a": 1}'), (2, "a,b\n1,2"), (3, "words only")], "i int, t string").orderBy("i")
    assert [r[0] for r in texts.select(S.text_media(F.col("t"))).collect()] == ["text/html", "application/json", "text/csv", "text/plain"]


def test_providers(spark):
    body = lambda s: spark.createDataFrame([(s,)], "body string")
    works = P.openalex(body('{"results":[{"id":"W1","display_name":"T","doi":"https://doi.org/10.1234/A","publication_date":"2020-01-02","abstract_inverted_index":{"b":[1],"a":[0,2]},"primary_location":{"landing_page_url":"https://x.org","license":"cc-by"}}]}')).first()
    assert (works.doi, works.abstract, str(works.published)) == ("10.1234/a", "a b a", "2020-01-02")
    item = P.crossref(body('{"message":{"items":[{"DOI":"10.1234/B","title":["U"],"published":{"date-parts":[[2020]]},"issued":{"date-parts":[[2019,5,6]]}}]}}')).first()
    assert (item.title, str(item.published)) == ("U", "2019-05-06")
    hit = P.zenodo(body('{"hits":{"hits":[{"id":"7","doi":"10.5281/z","links":{"self_html":"https://z.org/7"},"metadata":{"title":"Z","publication_date":"2021-01-01","license":{"id":"mit"}},"files":[{"key":"a.CSV"},{"key":"b.fit"}]}]}}')).first()
    assert hit.formats == ["csv", "fits"]
    assert P.serp(body('{"organic_results":[{"title":"a","link":"ftp://x"},{"title":"b","link":"https://y"}]}')).count() == 1
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>A\n B</title><published>2020-01-01T00:00:00Z</published></entry></feed>'
    assert P.arxiv(body(atom)).first().title == "A B"
