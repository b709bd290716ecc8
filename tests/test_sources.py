from __future__ import annotations

import io

import pandas as pd
import pytest

from pairloom.sources import files

CSV = 'a,b,c\n1,x # no,y\n# whole line\n2,"q # kept, ""so""",z#\n\n3,"two\nlines # kept",w\n4#,u,v\n5,"",t\r\n6,last'


def test_comments_in_mid_field(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.csv").write_bytes(CSV.encode())
    (tmp_path / "y.csv").write_text("a,b,c\n# nothing else\n")
    got = sorted((r.a, r.b, r.c) for r in files.read_csv(spark, str(tmp_path), "a int, b string, c string", comment="#", inline=True).collect())
    want = pd.read_csv(io.StringIO(CSV), comment="#", dtype=str)
    none = lambda x: None if pd.isna(x) else x
    assert [(a, (b or "").strip(), c) for a, b, c in got] == sorted((int(r.a), (none(r.b) or "").strip(), none(r.c)) for r in want.itertuples())
    whole = files.read_csv(spark, str(tmp_path / "deep"), "a string, b string, c string", comment="#").collect()
    assert ("1", "x # no", "y") in {tuple(r) for r in whole}


@pytest.mark.parametrize(("errors", "text"), [("replace", "ok � end é"), ("ignore", "ok  end é"), ("strict", None)])
def test_bytes_that_are_no_text(spark, tmp_path, errors, text):
    (tmp_path / "a.C").write_bytes(b"ok \xff end \xc3\xa9")
    (tmp_path / "b.c").write_bytes("fine � é\n".encode())
    (tmp_path / "c.txt").write_bytes(b"no source")
    df = files.read_files(spark, str(tmp_path), (".c", ".h"), errors=errors)
    if text is None:
        with pytest.raises(Exception, match="(?i)malformed|charact"):
            df.collect()
    else:
        assert {r.path[-3:]: r.content for r in df.collect()} == {"a.C": text, "b.c": "fine � é\n"}
        listing = files.read_listings(spark, str(tmp_path), "*.C", errors).first().content
        assert listing == text
    with pytest.raises(ValueError):
        files.read_listings(spark, str(tmp_path), errors="other")
