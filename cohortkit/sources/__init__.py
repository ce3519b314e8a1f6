from cohortkit.sources.tables import (  # noqa: F401
    bucket_count, read_bucketed, read_feature_table, read_sheet, write_bucketed, write_csv_report, write_feature_table,
    write_labels, write_result_tables,
)
