"""Declared schemas, value domains and reference rows of the financial-fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Enum domains in their declared order, which is also their sort order.
PERIODS = ("Q1", "H1", "Q3", "FY", "MONTHLY")
REVIEW_STATUS = ("DRAFT", "PENDING_REVIEW", "VERIFIED", "REJECTED")
STATEMENTS = ("INCOME_STATEMENT", "BALANCE_SHEET", "CASH_FLOW", "OTHER")
NATURES = ("FLOW", "STOCK", "PER_SHARE", "RATIO", "TEXT")
SEVERITY = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
JOB_STATUS = ("QUEUED", "CLAIMED", "RUNNING", "RETRY_WAIT", "NEEDS_INPUT", "SUCCEEDED", "FAILED", "CANCELLED")
JOB_MOVES = {
    "QUEUED": ("CLAIMED", "CANCELLED"),
    "CLAIMED": ("RUNNING", "RETRY_WAIT", "FAILED", "CANCELLED"),
    "RUNNING": ("SUCCEEDED", "RETRY_WAIT", "NEEDS_INPUT", "FAILED", "CANCELLED"),
    "RETRY_WAIT": ("QUEUED", "CANCELLED"),
    "NEEDS_INPUT": ("QUEUED", "FAILED", "CANCELLED"),
    "FAILED": ("QUEUED",),
}
STATUS_GROUPS = {
    "NEED_REVIEW": ("UPLOADED", "PROCESSING", "PENDING_REVIEW"),
    "READY_TO_COMMIT": ("READY_TO_COMMIT",),
    "COMMITTED": ("COMMITTED",),
    "FAILED": ("FAILED",),
}

# Periods and codes of a report that is entered by hand.
BODY_PERIODS = ("Q1", "H1", "Q3", "FY")
BODY_VALUES = ("REV", "NET_PROFIT", "TOTAL_ASSETS", "TOTAL_LIAB", "EQUITY", "OCF")

# Canonical accounts as code, name, and for each statement and nature a first sort order; steps of ten.
ACCOUNT_BLOCKS = [
    ("INCOME_STATEMENT", 100, [
        ("REV", "Revenue", "FLOW"), ("COGS", "Cost of Goods Sold", "FLOW"), ("GROSS_PROFIT", "Gross Profit", "FLOW"),
        ("SGA", "Selling, General and Administrative Expense", "FLOW"), ("OPERATING_PROFIT", "Operating Profit / EBIT", "FLOW"),
        ("EBITDA", "EBITDA", "FLOW"), ("FINANCE_INCOME", "Finance Income", "FLOW"), ("FINANCE_COST", "Finance Cost", "FLOW"),
        ("FX_GAIN_LOSS", "Foreign Exchange Gain / Loss", "FLOW"), ("PRETAX_PROFIT", "Profit Before Tax", "FLOW"),
        ("TAX_EXPENSE", "Income Tax Expense", "FLOW"), ("NET_PROFIT", "Net Profit", "FLOW"),
        ("NET_PROFIT_PARENT", "Net Profit Attributable to Owners of Parent", "FLOW"),
        ("EPS_BASIC", "Basic Earnings per Share", "PER_SHARE"), ("EPS_DILUTED", "Diluted Earnings per Share", "PER_SHARE"),
    ]),
    ("BALANCE_SHEET", 300, [
        ("CASH", "Cash and Cash Equivalents", "STOCK"), ("SHORT_TERM_INVESTMENTS", "Short-term Investments", "STOCK"),
        ("AR", "Accounts Receivable", "STOCK"), ("OTHER_RECEIVABLES", "Other Receivables", "STOCK"), ("INV", "Inventory", "STOCK"),
        ("CURRENT_ASSETS", "Total Current Assets", "STOCK"), ("PPE", "Property, Plant and Equipment", "STOCK"),
        ("RIGHT_OF_USE_ASSETS", "Right-of-use Assets", "STOCK"), ("GOODWILL", "Goodwill", "STOCK"),
        ("INTANGIBLE_ASSETS", "Intangible Assets", "STOCK"), ("LONG_TERM_INVESTMENTS", "Long-term Investments", "STOCK"),
        ("TOTAL_ASSETS", "Total Assets", "STOCK"), ("AP", "Accounts Payable", "STOCK"), ("SHORT_TERM_DEBT", "Short-term Debt", "STOCK"),
        ("CURRENT_LIAB", "Total Current Liabilities", "STOCK"), ("LONG_TERM_DEBT", "Long-term Debt", "STOCK"),
        ("LEASE_LIABILITIES", "Lease Liabilities", "STOCK"), ("TOTAL_DEBT", "Total Debt", "STOCK"),
        ("TOTAL_LIAB", "Total Liabilities", "STOCK"), ("EQUITY", "Total Equity", "STOCK"),
        ("EQUITY_PARENT", "Equity Attributable to Owners of Parent", "STOCK"), ("RETAINED_EARNINGS", "Retained Earnings", "STOCK"),
    ]),
    ("CASH_FLOW", 600, [
        ("OCF", "Operating Cash Flow", "FLOW"), ("CAPEX", "Capital Expenditure", "FLOW"), ("ICF", "Investing Cash Flow", "FLOW"),
        ("CFF", "Financing Cash Flow", "FLOW"), ("DIVIDENDS_PAID", "Dividends Paid", "FLOW"), ("DEBT_ISSUED", "Debt Issued", "FLOW"),
        ("DEBT_REPAID", "Debt Repaid", "FLOW"), ("FCF", "Free Cash Flow", "FLOW"), ("NET_CHANGE_CASH", "Net Change in Cash", "FLOW"),
    ]),
]
# The seeded issuers.
ISSUERS = [
    ("ICBP", "Indofood CBP Sukses Makmur Tbk", "Consumer Non-Cyclicals", "Processed Foods", "IDR"),
    ("BTPS", "Bank BTPN Syariah Tbk", "Financials", "Banks", "IDR"),
    ("SMRA", "Summarecon Agung Tbk", "Properties", "Real Estate", "IDR"),
    ("MEDC", "Medco Energi Internasional Tbk", "Energy", "Oil & Gas", "USD"),
    ("POWR", "Cikarang Listrindo Tbk", "Utilities", "Independent Power Producer", "IDR"),
]
# The sample history as year, revenue, net profit, operating cash flow and debt.
HISTORY = [
    (2022, 64200, 5100, 7200, 33400),
    (2023, 67900, 6900, 9100, 32500),
    (2024, 72100, 7200, 10300, 30100),
    (2025, 76500, 7800, 11100, 28700),
    (2026, 82300, 8100, 11500, 27400),
]

ACCOUNTS = [(code, name, statement, nature, first + 10 * i) for statement, first, rows in ACCOUNT_BLOCKS for i, (code, name, nature) in enumerate(rows)]

STAMPS = "createdAt timestamp, updatedAt timestamp"
# Tables of the store, as DDL. Money is decimal(28,6); ids are strings; enums are strings within their domain.
TABLES: dict[str, str] = {
    "Company": f"id string, ticker string, name string, sector string, subsector string, country string, ipoYear int, currency string, fiscalYearEnd int, isActive boolean, {STAMPS}",
    "FinancialReport": f"id string, companyId string, year int, periodType string, periodStart timestamp, periodEnd timestamp, audited boolean, consolidated boolean, sourceType string, sourceFile string, status string, createdBy string, {STAMPS}",
    "FinancialStatement": f"id string, reportId string, statementType string, currency string, unitScale int, isConsolidated boolean, {STAMPS}",
    "CanonicalAccount": f"id string, code string, name string, displayNameId string, description string, definition string, investorMeaning string, aliases array<string>, relatedMetrics array<string>, positiveSignals array<string>, redFlags array<string>, sectorNotes string, sourceRefs array<struct<label:string,url:string>>, statementType string, valueNature string, normalBalance string, parentId string, level int, sortOrder int, isCalculated boolean, formula string, isActive boolean, {STAMPS}",
    "FinancialEntry": f"id string, reportId string, statementId string, canonicalAccountId string, reportedLabel string, rawText string, value decimal(28,6), scale int, currency string, isEstimated boolean, isVerified boolean, confidence double, sourcePage int, {STAMPS}",
    "AccountMapping": f"id string, sourceLabel string, normalizedLabel string, companyId string, statementType string, canonicalAccountId string, method string, confidence double, isApproved boolean, {STAMPS}",
    "DataWarning": "id string, reportId string, code string, message string, severity string, resolved boolean, resolvedBy string, resolvedAt timestamp, createdAt timestamp",
    "SourceFile": "id string, reportId string, sourceType string, fileName string, mimeType string, fileSize int, checksum string, createdAt timestamp",
    "AuditLog": "id string, reportId string, action string, actor string, entity string, entityId string, before string, after string, note string, createdAt timestamp",
    "ExtractionRun": f"id string, companyId string, reportId string, fileName string, mimeType string, fileSize int, checksum string, year int, periodType string, currency string, unitScale int, status string, parserVersion string, pageCount int, errorMessage string, {STAMPS}",
    "ExtractionChunk": "id string, runId string, ordinal int, chunkType string, pageStart int, pageEnd int, section string, text string, textHash string, metadata struct<processingMode:string,preflightConfidence:double,preflightReason:string,openAiResponseId:string>, createdAt timestamp",
    "ExtractionCandidate": f"id string, runId string, chunkId string, statementType string, reportedLabel string, normalizedLabel string, rawValue string, numericValue decimal(28,6), currency string, scale int, sourcePage int, sourceText string, canonicalAccountId string, extractionConfidence double, mappingConfidence double, mappingMethod string, status string, reviewNote string, reviewedBy string, reviewedAt timestamp, {STAMPS}",
    "UploadSession": f"id string, correlationId string, objectKey string, fileName string, mimeType string, fileSize bigint, partSize bigint, status string, expiresAt timestamp, {STAMPS}",
    "UploadPart": "id string, uploadSessionId string, partNumber int, etag string, size bigint, createdAt timestamp",
    "FinancialDocument": f"id string, uploadSessionId string, objectKey string, checksum string, fileSize bigint, status string, {STAMPS}",
    "Job": f"id string, correlationId string, type string, status string, priority int, payload string, deduplicationKey string, documentId string, attemptCount int, maxAttempts int, availableAt timestamp, claimedBy string, claimToken string, claimedAt timestamp, leaseExpiresAt timestamp, lastHeartbeatAt timestamp, providerResponseId string, errorCode string, errorMessage string, completedAt timestamp, {STAMPS}",
    "JobAttempt": "id string, jobId string, attemptNumber int, workerId string, claimToken string, status string, startedAt timestamp, finishedAt timestamp, durationMs bigint, errorCode string, errorMessage string",
    "JobEvent": "id string, jobId string, attemptId string, eventType string, fromStatus string, toStatus string, stage string, message string, createdAt timestamp",
    "MetadataAssertion": f"id string, documentId string, field string, value string, status string, confidence double, page int, {STAMPS}",
    "AsyncExtractionJob": f"id string, fileName string, mimeType string, fileSize int, checksum string, status string, openAiResponseId string, runId string, detectedTicker string, detectedCompanyName string, detectedYear int, detectedPeriodType string, errorMessage string, preflight struct<processingMode:string,hasLikelyTextLayer:boolean,confidence:double,reason:string>, fileData binary, {STAMPS}",
}
# The extraction service's answer.
EXTRACTION = "detectedCompanyTicker string, detectedCompanyName string, detectedCompanyConfidence double, detectedYear int, detectedPeriodType string, detectedPeriodConfidence double, detectedCurrency string, detectedUnitScale int, pageCount int, chunks array<struct<section:string,chunkType:string,pageStart:int,pageEnd:int,textSummary:string>>, candidates array<struct<statementType:string,reportedLabel:string,rawValue:string,numericValue:double,currency:string,scale:int,sourcePage:int,sourceText:string,canonicalCode:string,extractionConfidence:double,mappingConfidence:double>>"


def schema(name: str) -> T.StructType:
    """A table's declared schema."""
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of the store without rows."""
    return spark.createDataFrame([], schema(name))


def accounts(spark: SparkSession) -> DataFrame:
    """The canonical accounts: code, name, statement, nature and sort order."""
    return spark.createDataFrame(ACCOUNTS, "code string, name string, statement_type string, value_nature string, sort_order int")


def issuers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISSUERS, "ticker string, name string, sector string, subsector string, currency string")


def history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HISTORY, "year int, revenue int, net_profit int, ocf int, debt int")
