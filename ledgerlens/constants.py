"""Values that must be identical to the application this library re-expresses
for results to agree: word lists, patterns, labels and text formats.

FIXED VALUES — keep as written; everything else in the package is derived.
"""

# FIXED VALUES: words that send a question to the chart branch (substring test)
CHART_KEYWORDS = ["chart", "plot", "graph", "visualize"]

# FIXED VALUES: year tokens looked for in a chart question
YEAR_2024 = "2024"
YEAR_2025 = "2025"

# FIXED VALUES: answer-abstention patterns, matched on cleaned lower-case text
REFUSAL_PATTERNS = [
    r"\b(i (do not|don't) know)\b",
    r"\b(not (in|within) (the )?(kb|knowledge base|documents|docs))\b",
    r"\b(cannot|can't) (find|locate)\b",
    r"\b(no (information|data) (available|found))\b",
    r"\b(insufficient (context|information))\b",
    r"\bout[- ]of[- ]kb\b",
    r"\b(i cannot (answer|provide))\b",
    r"\b(no (knowledge|record) of this)\b",
]

# FIXED VALUES: cohort labels and the sheet-name aliases tried, in order
COHORT_KNOWN = "Known"
COHORT_INFERRED = "Inferred"
COHORT_OUT_OF_KB = "Out of KB"
ALIASES_KNOWN = ["Known", " known ", "KNOWN"]
ALIASES_INFERRED = ["Infered", "Inferred"]
ALIASES_OUT_OF_KB = ["Out of KB", "Out-of-KB", "Out of Knowledge Base",
                     "OutOfKB", "OutKB", "Out of Kb", "Out of K B"]
# the one label fix applied before trend statistics
LABEL_FIXES = {"Infered": "Inferred"}

# FIXED VALUES: retrieval depths stored per evaluation row
K_VALUES = [1, 3, 5]
# FIXED VALUES: default number of retrieved documents / top companies
DEFAULT_TOP_K = 5
TOP_COMPANIES = 5
PREVIEW_CHARS = 1200

# FIXED VALUES: context formatting for retrieved documents
DOC_SEPARATOR = "\n\n---\n\n"
MISSING_META = "?"

# FIXED VALUES: prompt template ({reviews} = formatted context)
PROMPT_TEMPLATE = """
You are an expert financial analyst. 
Answer the question based on the company financial reports below.

Here are some relevant company records:{reviews}

Here is the question to answer: {question}

If the questions is not relevant to financial reports, please reply accordingly.
"""

# FIXED VALUES: chart answers
CHART_OK_MESSAGE = "Here is the bar chart you requested 📊"
CHART_FAIL_MESSAGE = "Sorry, I couldn’t generate a chart for that query."
SERIES_FY = {2024: "Revenue in 2024", 2025: "Revenue in 2025"}
SERIES_H1 = {2024: "Revenue H1 2024", 2025: "Revenue H1 2025"}

# FIXED VALUES: directory display fallbacks
NO_DESCRIPTION = "No description provided."
DIRECTORY_COLUMNS = ["company_name", "company_code", "industry", "description"]

# FIXED VALUES: trend statistics
Z_95 = 1.96
QUANTILE_LO = 0.02
QUANTILE_HI = 0.98
AXIS_PAD_TRENDS = 0.08
QUALITY_METRICS = ["rougeL", "semantic_cosine"]
METRIC_COLUMNS = ["rougeL", "semantic_cosine", "good_refusal", "hallucination_rate"]

# FIXED VALUES: document template, one (label, field) per line, in order.
# The first line carries two fields. Two labels of the source application
# were wrong (FY2024 profit labelled 2025, H1-2025 P/E labelled 2024); they
# are corrected here.
DOC_FIRST_LINE = ("Company: ", "company_name", " (Code: ", "company_code", ")")
DOC_LINES = [
    ("Industry: ", "industry"),
    ("Description: ", "description"),
    ("Information: ", "additional_info"),
    ("Website: ", "website"),
    ("ASX: ", "asx_page"),
    ("Revenue (H1 2025) in AUD: ", "rev_h1_2025"),
    ("Revenue (H1 2024) in AUD: ", "rev_h1_2024"),
    ("Revenue Change: ", "rev_h1_change"),
    ("Profit After Tax (H1 2025) in AUD: ", "profit_h1_2025"),
    ("Profit After Tax (H1 2024) in AUD: ", "profit_h1_2024"),
    ("Profit Change H1: ", "profit_h1_change"),
    ("Revenue (Full Year 2025): ", "rev_fy_2025"),
    ("Revenue (Full Year 2024): ", "rev_fy_2024"),
    ("Revenue Change Full Year: ", "rev_fy_change"),
    ("Profit After Tax (Full Year 2025) in AUD: ", "profit_fy_2025"),
    ("Profit After Tax (Full Year 2024) in AUD: ", "profit_fy_2024"),
    ("Profit Change Full Year: ", "profit_fy_change"),
    ("Equity: ", "equity"),
    ("Shares: ", "shares_mn"),
    ("Market price: ", "market_price"),
    ("EPS (H1 2025): ", "eps_h1_2025"),
    ("EPS (H1 2024): ", "eps_h1_2024"),
    ("Price-to-Earnings (P/E, H1 2025): ", "pe"),
    ("Book Value per Share (BVPS): ", "bvps"),
    ("Price-to-Book Ratio (P/B): ", "pb"),
]
# every line but the first is indented; one field is followed by spaces
DOC_INDENT = "        "
DOC_LINE_ENDS = {"rev_fy_2025": "       "}
NULL_TEXT = "nan"

# FIXED VALUES: headings of the company sheet as exported by the application,
# in sheet order, each with the canonical column it is renamed to on ingest.
COMPANY_SHEET_HEADINGS = [
    ("company_name", "Company name"),
    ("company_code", "Company Code"),
    ("industry", "Industry Group"),
    ("description", "Company Description"),
    ("additional_info", "Additional Information"),
    ("website", "Company Website"),
    ("asx_page", "Company page in ASX"),
    ("rev_h1_2025", "Half year ending June 2025 Revenue"),
    ("rev_h1_2024", "Half year ending June 2024 Revenue"),
    ("rev_h1_change", "Revenue Half year Percentage Change"),
    ("profit_h1_2025", "Half year ending June 2025 Profit after tax attributable to "
                       "shareholders (net earnings) in Mn"),
    ("profit_h1_2024", "Half year ending June 2024 Profit after tax attributable to "
                       "shareholders (net earnings) in Mn"),
    ("profit_h1_change", "Profit after tax attributable to shareholders (net earnings) "
                         "Percentage Change"),
    ("rev_fy_2025", "Revenue for full year ending Jun 25 in mn in AUD"),
    ("rev_fy_2024", "Revenue for full year ending Jun 24 in mn in AUD"),
    ("rev_fy_change", "Revenue for full year percentage change"),
    ("profit_fy_2025", "Full year ending June 2025 Profit after tax attributable to "
                       "shareholders (net earnings) in Mn"),
    ("profit_fy_2024", "Full year ending June 2024 Profit after tax attributable to "
                       "shareholders (net earnings) in Mn"),
    ("profit_fy_change", "Full year ending June 2024 Profit after tax attributable to "
                         "shareholders percentage change"),
    ("equity", "Equity for shareholder in Mn AUD"),
    ("shares_mn", "Number of Shares in Millions"),
    ("market_price", "Market Price in AUD on 15th Sep  2025"),
    ("eps_h1_2025", "Earnings per Share (AUD) for half year ending June 2025 (Net Profit "
                    "attributable to share holder) divided by Number of shares"),
    ("eps_h1_2024", "Earnings per Share (AUD) for half year ending June 2024 (Net Profit "
                    "attributable to share holder) divided by Number of shares. EPS measures "
                    "how much profit a company generates for each outstanding share of its "
                    "stock. Interpretation: A higher EPS generally means the company is more "
                    "profitable on a per-share basis, which is positive for shareholders. "),
    ("pe", "Price to Earnings ratio (x) for half year ending June 2025 : Market price divided "
           "by Earnings per share. The PE ratio shows how much investors are willing to pay "
           "for each dollar of the companys earnings. It compares the companys share price "
           "with its earnings per share. Interpretation: A high P/E ratio suggests the market "
           "expects strong future growth (but it could also mean the stock is overpriced). A "
           "low PE ratio may indicate undervaluation or slower growth expectations. "),
    ("bvps", "Book value per share (AUD): Equity for shareholder/Number of shares. Book Value "
             "per Share (BVPS) is a financial ratio that represents the net asset value of a "
             "company available to each outstanding share of common stock. BVPS shows the "
             "accounting value of each share if the company were liquidated today, based on "
             "its historical cost of assets and liabilities. Comparison with Market Price: "
             "Market Price per Share > BVPS: Investors believe the company has strong future "
             "earnings power, intangible assets (brand, patents, goodwill), or growth "
             "potential not fully reflected on the balance sheet. Market Price per Share < "
             "BVPS: Could indicate the stock is undervalued, or it may signal concerns about "
             "profitability, asset quality, or growth. Indicator of Financial Strength: A "
             "higher BVPS over time suggests the company is consistently building value for "
             "shareholders (through retained earnings, reinvestments). A declining BVPS could "
             "mean losses, high dividend payouts, or write-downs of assets."),
    ("pb", "Price to Book value (x): Market price/Book value per share: It shows how much "
           "investors are willing to pay for each $1 of book value (net assets) of the "
           "company."),
]
