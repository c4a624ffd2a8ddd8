"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

FIELD = "struct<name:string,type:string,nullable:boolean>"
PARAM = f"struct<name:string,type:string,type_expr:string,nullable:boolean,variadic:boolean,expanded:array<{FIELD}>>"
RETURN_VALUE = f"struct<name:string,type:string,type_expr:string,nullable:boolean,expanded:array<{FIELD}>>"
RETURNS = f"struct<multiple:boolean,values:array<{RETURN_VALUE}>>"

RECORD = (
    "struct<name:string,qualified_name:string,file:string,package:string,language:string,start_line:int,end_line:int,kind:string,receiver:string,exported:boolean,tag:string,"
    f"contract_completeness:string,ordinal:int,least_args:int,most_args:int,parameters:array<{PARAM}>,returns:{RETURNS}>"
)
CALL_SITE = "struct<line:int,called_name:string,arg_count:int>"

FUNCTIONS = (
    "node_id bigint, label string, name string, qualified_name string, file string, package string, module string, language string, start_line int, end_line int, kind string, receiver string, "
    f"exported boolean, tag string, is_test boolean, contract_completeness string, ordinal int, least_args int, most_args int, parameters array<{PARAM}>, returns {RETURNS}, contract string"
)
EDGES = "edge_id bigint, src bigint, dst bigint, label string, data_shape map<string,string>"
META = "schema_version bigint, tool_version string, build_time timestamp, function_count bigint, file_count bigint, languages array<string>"
SOURCES = "path string, language string, ext string, content binary"

#: columns of a query's result row
INFO = ("name", "qualified_name", "file", "start_line", "end_line", "module", "exported", "tag", "contract", "contract_completeness")

LANGUAGES = ("go", "java", "typescript", "python")
EXTENSIONS = {".go": "go", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
