"""The data model: vertex and edge tables of a code graph."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_TYPES = ("Package", "File", "Function", "Method", "Struct", "Interface", "Module", "Component", "Type", "Class", "Enum", "Trait")
EDGE_TYPES = ("CONTAINS", "DEFINES", "CALLS", "IMPORTS", "HAS_METHOD", "IMPLEMENTS", "USES_COMPONENT", "CALLS_API", "EXTENDS", "USES_TYPE")
LANGUAGES = ("go", "typescript", "python", "rust", "java", "c", "cpp", "ruby", "php", "csharp", "kotlin", "swift")

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("package", T.StringType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("repo", T.StringType()),
        T.StructField("community", T.StringType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("receiver", T.StringType()),
        T.StructField("params", T.ArrayType(T.StringType())),
        T.StructField("return_type", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("embeds", T.ArrayType(T.StringType())),
        T.StructField("method_signatures", T.ArrayType(T.StringType())),
        T.StructField("is_default", T.BooleanType()),
        T.StructField("props", T.ArrayType(T.StringType())),
        T.StructField("import_path", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
    ]
)

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("edge_seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField(
            "metadata",
            T.StructType([T.StructField("http_method", T.StringType()), T.StructField("url_pattern", T.StringType())]),
        ),
    ]
)

#: Names of the pattern language's properties and the columns behind them.
PROPERTIES = {
    "id": "id", "type": "type", "name": "name", "file": "file", "startLine": "start_line", "endLine": "end_line",
    "language": "language", "package": "package", "exported": "exported", "receiver": "receiver",
    "returnType": "return_type", "importPath": "import_path",
}
