"""Fixed values that results depend on."""

# SAM FLAG bits.
PAIRED = 0x1
PROPER_PAIR = 0x2
UNMAPPED = 0x4
SECONDARY = 0x100
DUPLICATE = 0x400
SUPPLEMENTARY = 0x800

# Aux tags kept from an alignment record.
WANTED_TAGS = ("CB", "CR", "UB", "UR", "GX", "GN", "RE", "RG", "MM", "mm", "NH", "xf")

# Name patterns (Java and RE2 syntax).
MITO_PATTERN = "(?i)^(?:chrM|MT|M)$"
ALT_DECOY_PATTERN = r"(?i)(?:_alt$|_decoy$|(?:^|_)HLA-|(?:^|_)KI\d|(?:^|_)GL\d)"
SEX_PATTERN = "(?i)^(?:chr)?[XY]$"
CHR_NAME_PATTERN = r"(?i)^chr(?:\d+|X|Y|M)$"
BARE_NAME_PATTERN = r"(?i)^(?:\d+|X|Y|MT)$"
PRIMARY_CHR_PATTERN = r"^chr(?:[1-9]|1\d|2[0-2]|X|Y)$"
PRIMARY_BARE_PATTERN = r"^(?:[1-9]|1\d|2[0-2]|X|Y)$"
SUPPORTED_PATTERN = r"(?i)\.(?:bam|bai|fai|(?:fastq|fq)(?:\.gz)?)$"
FASTQ_PATTERN = r"(?i)\.(?:fastq|fq)(?:\.gz)?$"
FASTQ_ROLE_PATTERN = r"(?i)(?:^|[_-])([RI])([12])(?:[_-]\d+)?$"
LANE_PATTERN = r"(?i)[_-]L(\d{3})[_-]"
READ_NUMBER_PATTERN = r"(?:\s|/)([12])(?:[:\s]|$)"
ILLUMINA_PATTERN = (
    r"^@?([^: ]+):(\d+):([^: ]+):(\d+):(\d+):(\d+):(\d+)\s+([12]):([YN]):(\d+):([^\s]+)"
)
POLY_A_PATTERN = "A{12,}$"
POLY_G_PATTERN = "G{12,}$"

# FASTQ alphabet and adapter.
BASE_ALPHABET = "ACGTNRYKMSWBDHV.-"
ADAPTER = "AGATCGGAAGAGC"
PHRED_OFFSET = 33
GC_BINS = 21

# Length of chromosome 1 in the recognised assemblies.
BUILDS = (
    ("GRCh38 / hg38", 248956422),
    ("GRCh37 / hg19", 249250621),
    ("GRCm38 / mm10", 195471971),
    ("GRCm39 / mm39", 195154279),
)
SMALL_CONTIG = 1_000_000
MIN_PRIMARY = 20
FULL_PRIMARY = 24
SPECIAL_CONTIGS_SHOWN = 20

# Statistics.
WILSON_Z = 1.96
KNEE_MIN_BARCODES = 50
KNEE_START = 0.002
KNEE_END = 0.92
KNEE_MIN_SPAN = 10
KNEE_MEDIUM_BARCODES = 500
KNEE_MEDIUM_CURVATURE = 0.08

# Report sizes.
TOP_GENES = 15
TOP_READ_GROUPS = 20
TOP_SEQUENCES = 8
TOP_REFERENCES = 40
FAI_ROWS_SHOWN = 100
ERRORS_SHOWN = 5

# Interpretation thresholds.
TAG_PRESENT = 0.1
REGION_TAG_PRESENT = 0.05
MAPPED_GOOD = 0.9
DUPLICATE_GOOD = 0.5
GENE_GOOD = 0.5
MITO_GOOD = 0.2
SC_RNA = "Single-cell RNA sequencing"
R1_RANGE = (24, 32)
R1_EXACT = 28
R2_MIN = 50
R2_TOLERANCE = 5
BARCODE_V3 = 16
UMI_V3 = 12

# Sampling budgets (quick, deep); a FASTQ file may also be read whole.
RECORD_TARGET = {"quick": 40_000, "deep": 150_000}
SEEK_POINTS = {"quick": 24, "deep": 48}
READ_TARGET = {"quick": 50_000, "deep": 200_000, "whole": None}
PROBE_POINTS = 64
CHECKPOINT_RECORDS = 25_000
CHECKPOINTS_NEEDED = 4
STABLE_FRACTION = 0.01
STABLE_MEDIAN = 2

# BAI layout.
META_BIN = 37450
