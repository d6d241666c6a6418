"""Cleaning of experiment records: one lazy projection per record kind, no row functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions import measures as M
from fathomry.functions import text as X
from fathomry.operators.selection import fill_defaults

# Mean bytes per image of each data folder suffix.
MEAN_BYTES = {
    "": 147531475882 / 1281167,
    "-150x": 147531475882 / 1281167,
    "-png2": 1750011440471 / 1281167,
}


def utc(text: str | Column) -> Column:
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def suffix_dimension(spark, mean_bytes: Mapping[str, float] = MEAN_BYTES) -> DataFrame:
    rows = [(k, float(v)) for k, v in mean_bytes.items()]
    return spark.createDataFrame(rows, "data_dir_suffix string, mean_bytes_per_image double")


def _unread_times() -> Column:
    """Why a run can't be cleaned: the times that are there and do not parse. Null where it can."""
    unread = [F.when(F.col(c).isNotNull() & utc(c).isNull(), F.lit(c)) for c in ("utc_begin", "utc_end")]
    return F.concat(F.lit("not a time: "), F.nullif(F.concat_ws(", ", *unread), F.lit("")))


def _training_rates(raw: DataFrame, gpus: str) -> DataFrame:
    """Parsed times and rates of the runs that can be cleaned and are not in error."""
    good = raw.filter(_unread_times().isNull() & ~F.col("error"))
    parsed = good.withColumns({"utc_begin": utc("utc_begin"), "utc_end": utc("utc_end"), "images_per_sec": X.last_number("output")})
    return parsed.withColumn("images_per_sec_per_gpu", F.try_divide("images_per_sec", F.col(gpus)))


def _with_bytes(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    joined = df.join(suffixes, "data_dir_suffix", "left")
    return joined.withColumn("MB_per_sec", F.col("images_per_sec") * F.col("mean_bytes_per_image") * 1e-6)


def clean_training_results(raw: DataFrame, suffixes: DataFrame, storage_type: str | None = None) -> DataFrame:
    """Times, rates and defaults of training runs; runs in error and runs that can't be cleaned are left out."""
    df = _training_rates(raw, "np")
    if storage_type is not None:
        df = df.withColumn("storage_type", F.lit(storage_type))
    return _with_bytes(fill_defaults(df, {"num_copies": 1.0, "image_format": "JPEG"}), suffixes)


def clean_second_training_results(raw: DataFrame, suffixes: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """The second kind of training runs: ``num_gpus`` is np, images are JPEG, and flags and storage that older
    records lack are filled with ``defaults``, as is num_copies with 1."""
    df = _training_rates(raw.withColumn("num_gpus", F.col("np")), "num_gpus")
    df = fill_defaults(df.withColumn("image_format", F.lit("JPEG")), {"num_copies": 1.0, **defaults})
    return _with_bytes(df, suffixes)


def training_rejects(raw: DataFrame) -> DataFrame:
    """Runs that can't be cleaned, as they are, with the reason."""
    return raw.withColumn("reason", _unread_times()).filter(F.col("reason").isNotNull())


def clean_scan_results(raw: DataFrame) -> DataFrame:
    """Totals of batched scan runs; single-batch runs keep nulls in the derived columns."""
    batched = ~F.col("single_batch")
    derived = {
        "compute_sec": M.array_sum("compute_sec_list"),
        "input_files_size": M.nested_sum("input_file_sizes"),
        "num_input_files": M.nested_size("input_files"),
        "init_sec": F.col("glob_sec") + F.col("getsize_sec") + F.col("create_ddf_sec"),
    }
    df = raw.filter(~F.col("error")).withColumns(
        {"utc_begin": utc("utc_begin"), "utc_end": utc("utc_end")}
    )
    df = df.withColumns({k: F.when(batched, v) for k, v in derived.items()}).withColumns(
        {
            "compute_MB_per_sec": F.try_divide(1e-6 * F.col("input_files_size"), F.col("compute_sec")),
            "sec_per_batch": F.try_divide("compute_sec", F.col("num_batches")),
        }
    )
    return fill_defaults(df, {"compression": "None", "warmup": False})


def clean_stage_results(
    raw: DataFrame, gpus_per_host: Mapping[str, int], shared_dirs: Sequence[str], local_dirs: Sequence[str], shared_name: str
) -> DataFrame:
    """Phase times, sizes and resource minutes of sequencing runs.

    A phase counts when its nested result is present and not in error. Where both kinds of first
    phase are present the germline result wins.
    """
    ok = {
        p: F.col(f"{p}_result").isNotNull() & ~F.coalesce(F.col(f"{p}_result.error"), F.lit(False))
        for p in ("fq2bam", "germline", "deepvariant")
    }

    def first_phase(make) -> Column:
        return F.when(ok["germline"], make("germline_result")).when(ok["fq2bam"], make("fq2bam_result"))

    def errors(pattern: str, numeric: bool = True):
        pick = X.first_number if numeric else X.first_match
        return lambda result: pick(F.col(f"{result}.errors"), pattern)

    any_first = ok["germline"] | ok["fq2bam"]
    df = raw.withColumns(
        {
            "utc_begin": utc("utc_begin"),
            "utc_end": utc("utc_end"),
            "error": F.coalesce(F.col("error"), F.lit(False)),
            "total_minutes": F.col("elapsed_sec") / 60.0,
            "num_gpus_per_server": M.lookup("hostname", gpus_per_host),
            "data_layout": M.data_layout(
                F.col("args.input_dir"), F.col("args.temp_dir"), list(shared_dirs), list(local_dirs), shared_name
            ),
            "tool_version": first_phase(errors(X.PHASE_VERSION, numeric=False)),
            "bwa_mem_sec": first_phase(errors(X.BWA_MEM_TIME)),
            "bwa_mem_to_bam_writing_sec": first_phase(errors(X.PROCESSING_TIME)),
            "fq2bam_sec": F.when(ok["fq2bam"], F.col("fq2bam_result.elapsed_sec")),
            "germline_sec": F.when(ok["germline"], F.col("germline_result.elapsed_sec")),
            "haplotypecaller_sec": F.when(ok["germline"], errors(X.TOTAL_TIME)("germline_result")),
            "deepvariant_sec": F.when(ok["deepvariant"], F.col("deepvariant_result.elapsed_sec")),
            "fq_file_size_bytes": F.when(any_first, M.array_sum("fq_file_sizes")),
            "bam_file_size_GB": F.when(any_first, F.col("bam_file_size_bytes") * 1e-9),
            "haplotypecaller_gvcf_file_size_GB": F.when(ok["germline"], F.col("haplotypecaller_gvcf_file_size_bytes") * 1e-9),
            "deepvariant_gvcf_file_size_GB": F.when(ok["deepvariant"], F.col("deepvariant_gvcf_file_size_bytes") * 1e-9),
            "bwa_mem_to_bam_writing_utc_begin": first_phase(lambda r: utc(F.col(f"{r}.utc_begin"))),
            "deepvariant_utc_begin": F.when(ok["deepvariant"], utc(F.col("deepvariant_result.utc_begin"))),
            "deepvariant_utc_end": F.when(ok["deepvariant"], utc(F.col("deepvariant_result.utc_end"))),
        }
    )
    df = df.withColumns(
        {
            "num_servers": F.col("num_gpus") / F.col("num_gpus_per_server"),
            "total_gpu_minutes": F.col("num_gpus") * F.col("elapsed_sec") / 60.0,
            "sorting_to_bam_writing_sec": F.col("bwa_mem_to_bam_writing_sec") - F.col("bwa_mem_sec"),
            "fq_file_size_GB": F.col("fq_file_size_bytes") * 1e-9,
        }
    )
    df = phase_timeline(df, ok["germline"], ok["fq2bam"])
    minutes = ["bwa_mem", "bwa_mem_to_bam_writing", "sorting_to_bam_writing", "germline", "haplotypecaller", "deepvariant"]
    df = df.withColumns({f"{p}_minutes": F.col(f"{p}_sec") / 60.0 for p in minutes})
    by_server = ["bwa_mem_to_bam_writing", "haplotypecaller", "deepvariant"]
    return df.withColumns(
        {
            "total_server_minutes": F.col("num_servers") * F.col("elapsed_sec") / 60.0,
            **{f"{p}_server_minutes": F.col("num_servers") * F.col(f"{p}_sec") / 60.0 for p in by_server},
            **{f"{p}_gpu_minutes": F.col("num_gpus") * F.col(f"{p}_sec") / 60.0 for p in by_server},
        }
    )


def phase_timeline(df: DataFrame, germline: Column, fq2bam: Column) -> DataFrame:
    """Phase ends from begin plus seconds; the end of one phase is the start of the next."""
    begin = F.col("bwa_mem_to_bam_writing_utc_begin")
    written = M.plus_seconds(begin, F.col("bwa_mem_to_bam_writing_sec"))
    return df.withColumns(
        {
            "bwa_mem_utc_end": F.when(germline, M.plus_seconds(begin, F.col("bwa_mem_sec"))),
            "bwa_mem_to_bam_writing_utc_end": F.when(germline, written).when(
                fq2bam, utc(F.col("fq2bam_result.utc_end"))
            ),
            "haplotypecaller_utc_begin": F.when(germline, written),
            "haplotypecaller_utc_end": F.when(germline, utc(F.col("germline_result.utc_end"))),
        }
    )
