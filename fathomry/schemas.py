"""Input schemas, as DDL strings the readers hand to Spark."""

from __future__ import annotations

# Column names and types of the loan performance file, in file order.
PERFORMANCE = """
    loan_id bigint, monthly_reporting_period date, servicer string, interest_rate double,
    current_actual_upb double, loan_age double, remaining_months_to_legal_maturity double,
    adj_remaining_months_to_maturity double, maturity_date string, msa double,
    current_loan_delinquency_status int, mod_flag string, zero_balance_code string,
    zero_balance_effective_date date, last_paid_installment_date date, foreclosed_after date,
    disposition_date date, foreclosure_costs double, prop_preservation_and_repair_costs double,
    asset_recovery_costs double, misc_holding_expenses double, holding_taxes double,
    net_sale_proceeds double, credit_enhancement_proceeds double,
    repurchase_make_whole_proceeds double, other_foreclosure_proceeds double,
    non_interest_bearing_upb double, principal_forgiveness_upb double,
    repurchase_make_whole_proceeds_flag string, foreclosure_principal_write_off_amount double,
    servicing_activity_indicator string
"""

# Column names and types of the loan acquisition file, in file order.
ACQUISITION = """
    loan_id bigint, orig_channel string, seller_name string, orig_interest_rate double,
    orig_upb bigint, orig_loan_term bigint, orig_date date, first_pay_date date, orig_ltv double,
    orig_cltv double, num_borrowers double, dti double, borrower_credit_score double,
    first_home_buyer string, loan_purpose string, property_type string, num_units bigint,
    occupancy_status string, property_state string, zip bigint,
    mortgage_insurance_percent double, product_type string, coborrow_credit_score double,
    mortgage_insurance_type double, relocation_mortgage_indicator string
"""

# The columns removed before training.
NOT_FEATURES = [
    "loan_id", "orig_date", "first_pay_date", "seller_name", "monthly_reporting_period",
    "last_paid_installment_date", "maturity_date", "ever_30", "ever_90", "ever_180",
    "delinquency_30", "delinquency_90", "delinquency_180", "upb_12",
    "zero_balance_effective_date", "foreclosed_after", "disposition_date", "timestamp",
]

SELLER_NAMES = "seller_name string, new string"

COUNTERS = "t double, counter bigint, rate_gbps double, device int, port int, counter_name string"

STEP_LOG = """
    `@timestamp` string, batch_size int, rank int, hostname string, step int, num_bytes bigint,
    latency_sec double, sync_latency_sec double
"""

BOXES = "filename string, xmin double, ymin double, xmax double, ymax double"

SAMPLES = "sample_id string, coverage double"

ANNOTATION = """
    filename string, size struct<width: string, height: string>,
    object array<struct<name: string,
                        bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>
"""

_STAGE = """struct<command: string, utc_begin: string, utc_end: string, elapsed_sec: double,
    error: boolean, exit_code: int, command_timed_out: boolean, output: string, errors: string>"""

# One superset for every kind of result record; a field a record lacks reads as null.
RESULT = f"""
    test_uuid string, record_uuid string, batch_uuid string, sample_id string, hostname string,
    test string, utc_begin string, utc_end string, elapsed_sec double, error boolean,
    output string, model string, np int, num_hosts int, num_gpus int, num_workers int,
    batch_size int, batch_group_size int, num_batches int, num_inter_threads int,
    num_intra_threads int, datasets_num_private_threads int, datasets_prefetch_buffer_size int,
    num_copies double, cached boolean, fp16 boolean, mpi boolean, nvlink boolean,
    use_tf_layers boolean, image_format string, data_dir_suffix string, storage_type string,
    NVIDIA_TENSORFLOW_VERSION string, tensorflow_benchmark_git_hash string,
    metrics struct<nvidia_smi: struct<output: string>>,
    compute_sec_list array<double>, input_files array<array<string>>,
    input_file_sizes array<array<bigint>>, create_ddf_sec double, getsize_sec double,
    glob_sec double, dask_cudf_version string, compression string, file_format string,
    data_file_prefix string, partitions int, size_multiplier double, stripe_size_MiB int,
    single_batch boolean, warmup boolean, rmm_pool_allocator boolean,
    args struct<input_dir: string, temp_dir: string>, fq_pairs array<array<string>>,
    fq_file_sizes array<bigint>, bam_file_size_bytes bigint,
    haplotypecaller_gvcf_file_size_bytes bigint, deepvariant_gvcf_file_size_bytes bigint,
    fq2bam_result {_STAGE}, germline_result {_STAGE}, deepvariant_result {_STAGE}
"""
