"""Schemas of the relations that the stages exchange."""

from __future__ import annotations

IDA_RAW = "function_name string, full_define string, start_addr string, source_file string"
IDA_FUNCS = "key string, signature string, function_name string, assembly_code string, opti_level string"
SRC_FUNCS = "key string, key_words array<string>, signature string, function_name string, source_code string, hash decimal(20,0)"
SRC_DOC = (
    "metadata struct<source_file:string, extraction_timestamp:string, total_functions:int, extractor:string>, "
    "functions array<struct<function_id:int, function_name:string, signature:string, body:string>>"
)
ASM_DOC = (
    "metadata struct<arch:string, source_file:string, object_file:string, asm_file:string, extraction_timestamp:string, "
    "total_functions:int, extractor:string>, functions array<struct<function_id:int, name:string, start_addr:string, "
    "signature:string, body:string, full_definition:string>>"
)
DATASET = "key string, func_name string, asm_func string, src_func string, opti string"
INTERLEAVED = DATASET + ", new_group_id int, original_group_rank int"
LABELLED = "asm_func string, src_func string, opti string, label int"
FUNCTION_CODES = "id string, project_name string, file_name string, function_name string, function_code string, embedding array<float>"
CHAT = "messages array<struct<role:string, content:string>>"
RETRIEVED = "page_content string, metadata map<string,string>"
PARSED_FUNCTION = "array<struct<function_id:int, name:string, start_addr:string, signature:string, body:string>>"
