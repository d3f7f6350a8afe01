"""Status and error codes, their texts and the exceptions that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OK, FAILED = 0, 1
# Where the codes of each area begin.
CODE_BASES = {"server": 30000, "db": 40000, "index": 50000, "wal": 60000, "sst": 70000}
# The codes that the engine itself reports.
DB_META_TRANSACTION_FAILED = 40001
DB_ERROR = 40002
DB_NOT_FOUND = 40003
DB_ALREADY_EXIST = 40004
DB_INVALID_PATH = 40005
DB_BLOOM_FILTER_ERROR = 40009
DB_READ_BLOCK_ERROR = 40015
WAL_ERROR = 60001
WAL_META_ERROR = 60002
WAL_FILE_ERROR = 60003
WAL_PATH_ERROR = 60004
WAL_WRITE_ERROR = 60005
SERVER_INVALID_ARGUMENT = 30004
BLOCK_LIMIT_EXCEEDED = 30123
SST_BLOCK_FULL = 70001  # an area of its own, so that it doesn't share a number with WAL_ERROR
# The codes of every area, as number and name.
CODE_NAMES = {
    "server": "1 unexpected_error 2 unsupported_error 3 null_pointer 4 invalid_argument 5 file_not_found 6 not_implement 8 cannot_create_folder 9 cannot_create_file 10 cannot_delete_folder 11 cannot_delete_file 12 build_index_error 13 cannot_open_file 14 too_busy 15 unknown_version 100 collection_not_exist 101 invalid_collection_name 102 invalid_collection_dimension 104 invalid_vector_dimension 105 invalid_index_type 106 invalid_rowrecord 107 invalid_rowrecord_array 108 invalid_topk 109 illegal_vector_id 110 illegal_search_result 111 cache_full 112 write_error 113 invalid_nprobe 114 invalid_index_nlist 115 invalid_index_metric_type 116 invalid_index_file_size 117 out_of_memory 118 invalid_partition_tag 119 invalid_binary_query 120 read_error 121 index_has_existed 122 index_not_exist 123 block_num_exceed_limit",
    "db": "1 meta_transaction_failed 2 error 3 not_found 4 already_exist 5 invalid_path 6 incompatible_meta 7 invalid_meta_uri 8 empty_collection 9 bloom_filter_error 10 partition_not_found 11 out_of_storage 12 read_only 13 no_file_to_search 14 no_need_build_index 15 read_block_error",
    "index": "1 error 2 invalid_argument 3 unexpected_error 4 no_space",
    "wal": "1 error 2 meta_error 3 file_error 4 path_error 5 write_error",
    "sst": "1 block_full",
}
# How the text of a status begins.
PREFIXES = {OK: "OK ", DB_ERROR: "Error: ", DB_META_TRANSACTION_FAILED: "Database error: ", DB_NOT_FOUND: "Not found: ", DB_ALREADY_EXIST: "Already exist: ", DB_INVALID_PATH: "Invalid path: "}


def status_text(code: Column, message: Column) -> Column:
    """The text of a status; a NULL code is a status without a state: OK."""
    prefix = F.concat(F.lit("Error code("), code.cast("string"), F.lit("): "))
    for number, text in PREFIXES.items():
        prefix = F.when(code == number, text).otherwise(prefix)
    return F.when(code.isNull(), "OK").otherwise(F.concat(prefix, F.coalesce(message, F.lit(""))))


def code_area(code: Column) -> Column:
    out = F.lit("general")
    for area, base in CODE_BASES.items():
        out = F.when((code > base) & (code < base + 10000), area).otherwise(out)
    return out


def code_table(spark: SparkSession) -> DataFrame:
    """(code, area, name) of every code."""
    rows = []
    for area, text in CODE_NAMES.items():
        words = text.split()
        rows += [(CODE_BASES[area] + int(number), area, name) for number, name in zip(words[::2], words[1::2], strict=True)]
    return spark.createDataFrame(rows, "code int, area string, name string")


class StoreError(Exception):
    """An error with a status code."""

    code = DB_ERROR

    def __str__(self) -> str:
        return PREFIXES.get(self.code, f"Error code({self.code}): ") + super().__str__()


class NotFound(StoreError):
    code = DB_NOT_FOUND


class AlreadyExists(StoreError):
    code = DB_ALREADY_EXIST


class InvalidPath(StoreError):
    code = DB_INVALID_PATH


class InvalidKey(StoreError):
    code = SERVER_INVALID_ARGUMENT


class LogError(StoreError):
    code = WAL_ERROR
