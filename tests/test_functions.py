from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import parsing, text


@pytest.mark.parametrize(("name", "expected"), [
    ("_ZL32_hb_buffer_serialize_glyphs_jsonP11hb_buffer_tjjPcjPjP9hb_font_t27hb_buffer_serialize_flags_t", True),
    ("_ZNSt8ios_base4InitC1Ev", True), ("normal_function", False), ("?MyFunction@@YAHH@Z", True),
    ("_ZN11hb_buffer_t8add_infoERK15hb_glyph_info_t", True), ("hb_buffer_serialize", False),
])
def test_is_mangled(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(text.is_mangled(F.col("n"))).first()[0] is expected


@pytest.mark.parametrize(("name", "expected"), [
    ("_ZNSt8ios_base4InitC1Ev", "std::ios_base::Init::Init()"), ("_ZN11hb_buffer_t8add_infoERK15hb_glyph_info_t", "hb_buffer_t::add_info(hb_glyph_info_t const&)"),
    ("_Z3addii", "add(int, int)"), ("_ZN3fooD1Ev", "foo::~foo()"), ("_ZNK1a1bEv", "a::b() const"), ("_Z1fPKcS0_", "f(char const*, char const*)"),
    ("_Zgarbage", "_Zgarbage"), ("plain", "plain"), (None, None),
])
def test_demangle(name, expected):
    assert parsing.demangle(name) == expected


@pytest.mark.parametrize(("name", "expected"), [
    ("std::ios_base::Init::Init()", "std::ios_base::Init::Init"), ("hb_buffer_t::add_info(hb_glyph_info_t const&)", "hb_buffer_t::add_info"), ("f()", "f"),
    ("operator new(unsigned long)", "new"), ("foo(int) const", "const"), ("int bar<int>(int)", "bar<int>"), ("(anonymous namespace)::g(int)", ""), (None, None),
])
def test_plain_name(name, expected):
    assert parsing.plain_name(name) == expected


def test_listing(spark):
    listing = "x.o:     file format elf64\nDisassembly of section .text:\n\n0000000000000000 <f>:\n   0: push\n   1: ret\n\n0000000000000010 <g<int>>:\r\n  10: nop\n"
    odd = "0 <empty>:\n1 <next>:\n\n \n2 <a b>: \n  x <y>:\nnot hex <z>:\nzz <z>:\n"
    df = spark.createDataFrame([(1, listing), (2, None), (3, ""), (4, "no function"), (5, odd)], "k int, t string")
    got = {r.k: [(f.function_id, f.name, f.start_addr, f.body) for f in r.f] for r in df.select("k", parsing.listing_functions(F.col("t")).alias("f")).collect()}
    assert got[1] == [(1, "f", "0" * 16, "   0: push\n   1: ret"), (2, "g<int>", "0" * 14 + "10", "  10: nop")]
    assert got[2] == got[3] == got[4] == []
    assert got[5] == [(1, "empty", "0", ""), (2, "next", "1", ""), (3, "a b", "2", "  x <y>:\nnot hex <z>:\nzz <z>:")]


SOURCE = r"""
#define X(a) { a
/* int no(void) { } */
int proto(int a);
static int add(int a, int b) { const char *s = "}{"; return a + b; }
char *name(void)
{
    // }
    if (1) { return 0; }
    return '}';
}
struct s { int a; };
int table[] = { 1, 2 };
namespace ns { int inner() { return 1; }
class C { C() : a(1) { } ~C() { } int a; }; }
int ns::f(int x) { return x; }
bool operator==(const C& a, const C& b) { return true; }
int main(void) { return 0; }
"""


def test_source_functions():
    got = parsing.scan_functions(SOURCE)
    assert [f["name"] for f in got] == ["add", "name", "inner", "C", "~C", "ns::f", "operator==", "main"]
    assert got[1]["body"].startswith("// }") and got[1]["signature"].startswith("char *name(void)")
    assert parsing.scan_functions("int f(void) {") == [] and parsing.scan_functions(None) == []


def brute_simhash(s: str) -> int:
    import re

    content = "".join(re.findall(r"[\w一-鿌]+", s.lower()))
    grams = Counter(content[i : i + 4] for i in range(max(len(content) - 3, 1)))
    v = [0] * 64
    for g, n in grams.items():
        h = int(hashlib.md5(g.encode()).hexdigest()[-16:], 16)
        for b in range(64):
            v[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(64) if v[b] > 0)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_simhash(s):
    assert parsing.simhash(s) == brute_simhash(s)


def test_answers(spark):
    rows = [("1",), ("0",), (" 1 \nwhy",), ("yes",), ("",), ("2",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(text.answer_label(F.col("r"))).collect()]
    assert got == [1, 0, 1, None, None, 2, None]
    rows = [("0$1$2", 1), ("2$0", 1), ("1 $0", 1)]
    assert [r[0] for r in spark.createDataFrame(rows, "r string, i int").select(text.answer_place(F.col("r"), F.col("i"))).collect()] == [2, 0, 1]


def test_paths(spark):
    p = "/x/ida_funcs/tectonic-typesetting_____tectonic/-O0/hb-buffer-serialize.csv"
    c = F.col("p")
    row = spark.createDataFrame([(p,)], "p string").select(text.project(c), text.opt_level(c), text.file_stem(c)).first()
    assert tuple(row) == ("tectonic-typesetting_____tectonic", "O0", "hb-buffer-serialize")


def test_bounds(spark):
    six, seven = "|".join("abcdef"), "|".join("abcdefg")
    got = spark.createDataFrame([(six,), (seven,), (None,)], "c string").select(text.enough_instructions(F.col("c"))).collect()
    assert [r[0] for r in got] == [False, True, None]
    rows = [("main", "1\n2\n3\n4\n5"), ("f", "1\n2\n3\n4"), ("f", "1\n2\n3\n4\n5")]
    assert [r[0] for r in spark.createDataFrame(rows, "n string, b string").select(text.worth_keeping(F.col("n"), F.col("b"))).collect()] == [False, False, True]


def test_unsigned_and_maps(spark):
    row = spark.sql("SELECT -1L AS a, 5L AS b, map('x', 1, 'y', 2) AS m, map('y', 3) AS n").select(
        text.unsigned(F.col("a")).cast("string"), text.hamming(F.col("a"), F.col("b")), text.right_wins(F.col("m"), F.col("n")), text.duration(F.lit(3725))
    ).first()
    assert row[0] == "18446744073709551615" and row[1] == 62 and row[2] == {"x": 1, "y": 3} and tuple(row[3]) == (1, 2, 5)


@pytest.mark.parametrize(("name", "expected"), [
    ("_ZNSt6vectorIiSaIiEE9push_backERKi", "std::vector<int, std::allocator<int> >::push_back(int const&)"), ("_Z3maxIiET_S0_S0_", "int max<int>(int, int)"),
    ("_ZN1AplERKS_", "A::operator+(A const&)"), ("_Z1fPFivE", "f(int (*)())"), ("_Z1fRA3_i", "f(int (&) [3])"), ("_ZN1aILi3EE1gEv", "a<3>::g()"), ("_ZN1AcvbEv", "A::operator bool()"),
    ("_ZN1AIT", "_ZN1AIT"), ("_Z1fIT_E", "_Z1fIT_E"),
])
def test_demangle_templates_operators_and_functions(name, expected):
    assert parsing.demangle(name) == expected


def test_simhash_column(spark):
    texts = ["", "a", "Hello, world! hello", "语言 abc", None, "x" * 5000, "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.h for r in df.select("i", parsing.simhash64(F.col("t")).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert (None if got[i] is None else got[i] % (1 << 64)) == (None if t is None else brute_simhash(t))
