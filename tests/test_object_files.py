from __future__ import annotations

import struct

import pytest

from pairloom.providers import SymbolTables
from pairloom.sources import object_files
from pairloom.sources.object_files import read_objects

CODE = bytes(range(64))


def elf(functions, bits=2, order="<", extra=0):
    """An object file: a text section, a symbol table, and the tables of names."""
    names = b"\0" + b"".join(n.encode() + b"\0" for n, *_ in functions)
    at = {n: names.index(n.encode() + b"\0") for n, *_ in functions}
    symbols = [(0, 0, 0, 0, 0)] + [(at[n], value, size, kind, home) for n, value, size, kind, home in functions]
    table = b"".join(struct.pack(order + "IIIBBH", n, v, s, k, 0, h) if bits == 1 else struct.pack(order + "IBBHQQ", n, k, 0, h, v, s) for n, v, s, k, h in symbols)
    heads = b"\0.text\0.symtab\0.strtab\0"
    head, width = (52, 40) if bits == 1 else (64, 64)
    parts, offset, where = [CODE, table, names, heads], head, []
    for p in parts:
        where.append(offset)
        offset += len(p)
    kinds = [(0, 0, 0, 0, 0), (1, 1, where[0], len(CODE), 0), (7, 2, where[1], len(table), 3), (15, 3, where[2], len(names), 0), (15, 3, where[3], len(heads), 0)]
    section = lambda n, t, o, s, link: struct.pack(order + ("IIIIIIIIII" if bits == 1 else "IIQQQQIIQQ"), n, t, 0, 0, o, s, link, 0, 1, 0)
    ident = b"\x7fELF" + bytes([bits, 1 if order == "<" else 2, 1]) + bytes(9)
    header = struct.pack(order + ("HHIIIIIHHHHHH" if bits == 1 else "HHIQQQIHHHHHH"), 1, 62, 1, 0, 0, offset, 0, head, 0, 0, width, 5 + extra, 4)
    return ident + header + b"".join(parts) + b"".join(section(*k) for k in kinds)


GOOD = [("main", 0, 16, 0x12, 1), ("data", 0, 4, 0x11, 1), ("_ZN1a1bEv", 16, 8, 2, 1), ("outside", 0, 0, 0x12, 0), ("common", 0, 4, 0x12, 0xFFF2)]


@pytest.mark.parametrize(("bits", "order"), [(2, "<"), (2, ">"), (1, "<"), (1, ">")])
def test_functions_of_an_object(spark, tmp_path, bits, order):
    (tmp_path / "a.o").write_bytes(elf(GOOD, bits, order))
    got = [(r.function_id, r.function_name, r.start_addr, r.size, r.section, r.machine, bytes(r.code), r.error) for r in read_objects(spark, str(tmp_path)).orderBy("function_id").collect()]
    assert got == [(1, "main", 0, 16, ".text", 62, CODE[:16], None), (2, "_ZN1a1bEv", 16, 8, ".text", 62, CODE[16:24], None)]


def test_one_row_or_error_each(spark, tmp_path):
    good = elf(GOOD)
    made = {
        "good.o": good, "empty.o": b"", "text.o": b"int main() {}\n", "cut.o": good[:-70], "head.o": good[:20], "start.o": b"\x7fE",
        "none.o": elf(GOOD[1:2]), "class.o": good[:4] + b"\x07" + good[5:], "section.o": elf(GOOD, extra=3), "odd.o": elf([("far", 60, 50_000, 2, 1)]), "no.txt": good,
    }
    (tmp_path / "deep").mkdir()
    for name, data in made.items():
        (tmp_path / "deep" / name).write_bytes(data)
    got = {}
    for r in read_objects(spark, f"file://{tmp_path}", partitionBytes="300").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.error or r.function_name)
    assert got == {
        "good.o": ["main", "_ZN1a1bEv"], "empty.o": ["empty"], "text.o": ["not an object file"], "cut.o": ["cut off"], "head.o": ["cut off"], "start.o": ["not an object file"],
        "none.o": ["no functions"], "class.o": ["unsupported object file"], "section.o": ["cut off"], "odd.o": ["cut off"],
    }


def test_partitions_by_bytes_columns_and_timeout(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.o").write_bytes(elf([(f"f{k}_{j}", 0, 4, 2, 1) for j in range(30)]))
    size = len(elf([(f"f1_{j}", 0, 4, 2, 1) for j in range(30)]))
    df = read_objects(spark, str(tmp_path), partitionBytes=str(5 * size + 200), code="false")
    assert df.rdd.getNumPartitions() >= 4
    assert df.count() == 600 and df.where("code IS NULL").select("function_name").distinct().count() == 600
    late = read_objects(spark, str(tmp_path), timeout="-1").collect()
    assert {r.error for r in late} == {"timed out"} and len(late) == 20
    spark.sql(f"CREATE TEMPORARY VIEW objects USING objectfile OPTIONS (path '{tmp_path}')")
    assert spark.sql("SELECT count(DISTINCT path) FROM objects WHERE error IS NULL").first()[0] == 20
    spark.catalog.dropTempView("objects")
    with pytest.raises(Exception, match="FileNotFound"):
        read_objects(spark, str(tmp_path / "nowhere")).count()


def test_symbol_tables_stand_in_for_a_disassembler(spark, tmp_path):
    (tmp_path / "a.o").write_bytes(elf(GOOD))
    paths = [(str(tmp_path / "a.o"),), (f"file://{tmp_path}/a.o",), (str(tmp_path / "gone.o"),), (None,)]
    got = SymbolTables().functions(spark.createDataFrame(paths, "path string")).collect()
    assert sorted((r.path == paths[2][0], r.function_name or r.error) for r in got) == [(False, "_ZN1a1bEv")] * 2 + [(False, "main")] * 2 + [(True, "unreadable: FileNotFoundError")]


def test_empty_folder(spark, tmp_path):
    assert read_objects(spark, str(tmp_path)).count() == 0
    assert len(object_files.TYPES) == len(object_files.SCHEMA.split(", "))
