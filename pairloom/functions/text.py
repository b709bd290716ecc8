"""String, path and answer functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories left out of a source scan; source file extensions; prompts
EXCLUDED_DIRS = (
    "build", ".git", "test", "tests", "example", "examples", "tool", "tools", "demo", "demos",
    "sample", "samples", "benchmark", "benchmarks", "fuzz", "fuzzing",
)
ASM_PROMPT = "Analyze the following assembly code and understand its semantic meaning:\n```asm\n{code}\n```\nSemantic representation:"
SOURCE_PROMPT = "Analyze the following source code and understand its semantic meaning:\n```c\n{code}\n```\nSemantic representation:"
SOURCE_EXTENSIONS = (".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh")


def last_part(path: Column, n: int = 1) -> Column:
    """The n-th path part from the end; null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-n))


def file_stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(last_part(path), ".", 1)


def extension(path: Column) -> Column:
    """From the last dot of the file name, empty if there is none (or it leads)."""
    return F.regexp_extract(last_part(path), r"^.+(\.[^.]*)$", 1)


#: optimization levels of the common C compilers
LEVEL = "O(?:fast|[0-3sgz])"


def opt_level(path: Column, whole_path: bool = False) -> Column:
    """O0 to Ofast from a directory such as /-O2/; O0 if there is none.

    ``whole_path`` takes the first ``-O…`` anywhere in the path.
    """
    pattern = f"-({LEVEL})" if whole_path else f"/-({LEVEL})/"
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit("O0"))


def project(path: Column) -> Column:
    """The directory above the optimization level's, or the file's own directory."""
    return F.when(path.rlike(f"-{LEVEL}"), last_part(path, 3)).otherwise(last_part(path, 2))


def compose_key(project_: Column, file: Column, function: Column) -> Column:
    return F.concat_ws("$", project_, file, function)


def function_of_key(key: Column) -> Column:
    return F.element_at(F.split(key, r"\$"), -1)


def is_mangled(name: Column) -> Column:
    return name.rlike(r"^(_Z|__Z|\?)")


def path_keywords(path: Column, project_: Column) -> Column:
    """Sorted distinct path parts after the first that equals the project; null if there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, project_)
    rest = F.slice(parts, F.greatest(at.cast("int") + 1, F.lit(1)), F.size(parts))
    return F.when(at > 0, F.array_sort(F.array_distinct(rest)))


def enough_instructions(code: Column, least: int = 7) -> Column:
    return F.size(F.split(code, r"\|", -1)) >= least


def enough_chars(code: Column, least: int = 10) -> Column:
    return F.length(code) >= least


def worth_keeping(name: Column, body: Column, least_lines: int = 5) -> Column:
    """Not main, and a body of at least so many lines."""
    return (name != "main") & (F.size(F.split(body, "\n", -1)) >= least_lines)


def is_source(path: Column, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> Column:
    """The extension is known (in any case) and the name does not begin with test_."""
    return ~last_part(path).startswith("test_") & F.lower(extension(path)).isin(*extensions)


def not_excluded(path: Column, dirs: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """No directory of the path is on the list, the file's own included."""
    alternatives = "|".join(d.replace(".", r"\.") for d in dirs)
    return ~path.rlike(f"(^|/)({alternatives})/")


def language_of(path: Column) -> Column:
    return F.when(F.lower(extension(path)).isin(".c", ".h"), "c").otherwise("cpp")


def swap_extension(name: Column, old: str, new: str) -> Column:
    return F.regexp_replace(name, "\\." + old + "$", "." + new)


def json_name(relative: Column) -> Column:
    return F.concat(F.translate(relative, "/", "_"), F.lit(".json"))


def output_path(relative: Column, out: str, suffix: str = ".json") -> Column:
    """out/<directories>/<stem><suffix>; the directories stay, so files of one name do not meet."""
    folder = F.regexp_extract(relative, "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(last_part(relative), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("/", F.lit(out), F.nullif(folder, F.lit("")), F.concat(stem, F.lit(suffix)))


def object_paths(relative: Column, arch: str, native: str = "x86_64") -> Column:
    """struct<object, asm, json>: below the architecture's directory unless it is the native one."""
    base = F.regexp_replace(relative, r"\.[^./]*$", "")
    base = base if arch == native else F.concat(F.lit(arch + "/"), base)
    return F.struct(F.concat(base, F.lit(".o")).alias("object"), F.concat(base, F.lit(".s")).alias("asm"), F.concat(base, F.lit(".json")).alias("json"))


def join_instructions(addresses: Column, instructions: Column) -> Column:
    return F.array_join(F.zip_with(addresses, instructions, lambda a, i: F.concat_ws(" ", F.concat(F.lit("0x"), F.lower(F.hex(a))), i)), " | ")


def address(n: Column, padded: bool = False) -> Column:
    return F.format_string("%08X", n) if padded else F.concat(F.lit("0x"), F.lower(F.hex(n)))


def prompt(code: Column, kind: str, template: str | None = None) -> Column:
    """Wraps code for an encoder; kind is asm or c. A ``template`` of one's own holds {code} once."""
    templates = {"asm": ASM_PROMPT, "c": SOURCE_PROMPT}
    if template is None and kind not in templates:
        raise ValueError(f"unknown kind {kind!r}")
    parts = (templates[kind] if template is None else template).split("{code}")
    if len(parts) != 2:
        raise ValueError("a template holds {code} exactly once")
    return F.concat(F.lit(parts[0]), code, F.lit(parts[1]))


def token_ids(text: Column, max_length: int, vocabulary: int = 50_000, pad: int = 0) -> Column:
    """struct<input_ids, attention_mask, n_tokens>: stand-in for an encoder's tokenizer.

    Words between white space become ids by hash, cut at ``max_length`` and padded to it;
    n_tokens counts all. A null text has no words.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    ids = F.transform(F.slice(words, 1, max_length), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1).cast("int"))
    blank = lambda x, n: F.array_repeat(F.lit(x), n)
    short = F.lit(max_length) - F.size(ids)
    return F.struct(
        F.concat(ids, blank(pad, short)).alias("input_ids"), F.concat(blank(1, F.size(ids)), blank(0, short)).alias("attention_mask"), F.size(words).alias("n_tokens")
    )


def name_and_code(name: Column, code: Column) -> Column:
    return F.concat_ws("\n", name, code)


def join_docs(docs: Column) -> Column:
    """[SOURCE:id] and text of each document, a blank line between two; docs: array<struct<id, text>>."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("[SOURCE:"), F.coalesce(d["id"].cast("string"), F.concat(F.lit("doc_"), i)), F.lit("]\n"), d["text"])), "\n\n")


def first_line(response: Column) -> Column:
    return F.element_at(F.split(response, "\n"), 1)


def answer_label(response: Column) -> Column:
    """The integer on the answer's first line, else null."""
    return F.trim(first_line(response)).try_cast("int")


def answer_place(response: Column, idx: Column) -> Column:
    """1-based place of idx in the first line's $-separated list, 0 if missing."""
    return F.array_position(F.transform(F.split(first_line(response), r"\$"), lambda x: F.trim(x)), idx.cast("string"))


def judge_fields(response: Column) -> Column:
    """struct<function_code, explanation, citations, score, reason, is_grounded> with defaults for what is missing."""
    x = F.from_json(response, "function_code string, explanation string, citations array<struct<source_id:string,why:string>>, score int, reason string, is_grounded boolean")
    # taken apart inside a lambda, so the response is read once
    return F.element_at(F.transform(F.array(x), _with_defaults), 1)


def _with_defaults(x: Column) -> Column:
    return F.struct(
        F.coalesce(x["function_code"], F.lit("")).alias("function_code"), F.coalesce(x["explanation"], F.lit("")).alias("explanation"),
        F.coalesce(x["citations"], F.array().cast("array<struct<source_id:string,why:string>>")).alias("citations"),
        F.coalesce(x["score"], F.lit(0)).alias("score"), F.coalesce(x["reason"], F.lit("")).alias("reason"), F.coalesce(x["is_grounded"], F.lit(False)).alias("is_grounded"),
    )


def right_wins(base: Column, update: Column) -> Column:
    """Union of two maps, entries of the second on top."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def preview(text: Column, n: int = 100) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def duration(seconds: Column) -> Column:
    """h:mm:ss parts of a number of seconds."""
    s = F.floor(seconds)
    return F.struct(F.floor(s / 3600).alias("hours"), F.floor((s % 3600) / 60).alias("minutes"), (s % 60).alias("seconds"))


def model_memory_gb(billions: Column, quant: Column) -> Column:
    """Half a byte, one or two bytes a parameter, plus 2 GB."""
    return F.when(quant == "4bit", billions * 0.5).when(quant == "8bit", billions * 1.0).otherwise(billions * 2.0) + 2


def build_macros(path: Column, macros: dict[str, tuple[str, ...]]) -> Column:
    """Compiler macros by project names found in the path; names are matched in any case."""
    found = [F.when(F.lower(path).contains(name.lower()), F.array(*map(F.lit, flags))).otherwise(F.array().cast("array<string>")) for name, flags in macros.items()]
    return F.array_distinct(reduce(F.concat, found)) if found else F.array().cast("array<string>")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unsigned(h: Column) -> Column:
    """A signed 64-bit pattern as the unsigned number."""
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")
