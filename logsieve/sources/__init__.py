"""Log sources and sinks."""

from .custom import FileRange, LogfmtSource, LogSource, register_source
from .logs import LogIngestionError, detect_format, from_dataframe, read_csv_logs, read_json_logs, read_logs, read_text_logs, spread
from .sinks import read_training_samples, write_json_rows
from .uploads import UploadRegistry

__all__ = [
    "FileRange", "LogIngestionError", "LogSource", "LogfmtSource", "UploadRegistry", "detect_format", "from_dataframe", "read_csv_logs", "read_json_logs",
    "read_logs", "read_text_logs", "read_training_samples", "register_source", "spread", "write_json_rows",
]
