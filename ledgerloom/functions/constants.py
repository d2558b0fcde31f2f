"""Fixed values of the labelling rules, issuer codes and statement wording.

Everything below is a fixed value: results are only right when these lists hold exactly
these entries, in this order where the order decides which entry wins.
"""

# The spending categories, in display order.
CATEGORIES = [
    "Salary & Income",
    "Groceries & Supermarkets",
    "Food & Dining",
    "Utilities & Bills",
    "Shopping & E-Commerce",
    "Travel & Fuel",
    "Healthcare & Medical",
    "Entertainment & OTT",
    "Investments & Trading",
    "Loan EMI & Credit Card",
    "Cash & ATM Withdrawal",
    "Bank Charges & Taxes",
    "Transfer (P2P / Self)",
    "Miscellaneous / Others",
]

SALARY = "Salary & Income"
TRANSFER = "Transfer (P2P / Self)"
MISC = "Miscellaneous / Others"

# Literal tokens per category, in evaluation order of the categories.
TOKENS = {
    "Food & Dining": [
        "zomato", "swiggy", "mcdonald", "domino", "starbuck", "subway", "kfc", "restaurant",
        "cafe", "bakery", "dhaba", "food", "dine", "kitchen", "meals", "pizza", "burger",
        "coffee", "eatery", "bistro", "pub", "barbeque",
    ],
    "Groceries & Supermarkets": [
        "blinkit", "zepto", "bigbasket", "dmart", "reliancefresh", "spencer", "supermarket",
        "grocery", "provision", "mart", "store", "dairy", "milk", "vegetable", "fruit",
        "instamart", "hypermarket", "bakery", "bazaar", "kirana",
    ],
    "Shopping & E-Commerce": [
        "amazon", "flipkart", "myntra", "ajio", "meesho", "nykaa", "tatacliq", "zara",
        "decathlon", "ecommerce", "e-com", "retail", "apparel", "clothing", "shopping", "mall",
        "fashion", "footwear", "boutique", "electronics",
    ],
    "Travel & Fuel": [
        "uber", "ola", "rapido", "irctc", "makemytrip", "indigo", "airindia", "petrol", "fuel",
        "hpcl", "iocl", "bpcl", "fastag", "toll", "airline", "flight", "railway", "transit",
        "train", "metro", "bus", "cab", "taxi", "gas station", "parking", "shell petrol",
    ],
    "Utilities & Bills": [
        "bescom", "mseb", "tneb", "electricity", "billdesk", "airtel", "jio", "vodafone",
        "broadband", "gasbill", "billpay", "utility", "water board", "power corp", "recharge",
        "telecom", "dth", "postpaid", "dish tv",
    ],
    "Entertainment & OTT": [
        "netflix", "spotify", "primevideo", "hotstar", "bookmyshow", "pvr", "inox", "youtube",
        "cinema", "movie", "entertainment", "theatre", "streaming", "music", "gaming",
        "amusement",
    ],
    "Investments & Trading": [
        "zerodha", "groww", "upstox", "angelone", "mutualfund", "sip", "camsonline",
        "securities", "trading", "investment", "equities", "stock", "broker", "depository",
        "amc", "bse", "nse", "crypto",
    ],
    "Healthcare & Medical": [
        "apollo", "pharmeasy", "1mg", "netmeds", "hospital", "clinic", "pharmacy", "chemist",
        "doctor", "medical", "healthcare", "diagnostic", "lab", "dental", "meds", "druggist",
        "opticals",
    ],
    "Loan EMI & Credit Card": [
        "cred club", "creditcard", "emi", "bajajfinance", "homeloan", "carloan", "loan",
        "mortgage", "installment", "finance", "card payment", "credit card", "personal loan",
        "housing loan", "auto loan",
    ],
    "Cash & ATM Withdrawal": [
        "atm", "cashwdl", "cwdr", "cdm", "cash wdl", "cash withdrawal", "nfs*cash", "atm wdl",
        "self cash", "branch cash",
    ],
    "Salary & Income": [
        "salary", "payroll", "int.pd", "dividend", "bonus", "stipend", "wage",
        "direct deposit", "pension", "honorarium", "interest paid", "interest cr",
        "consulting fee", "freelance",
    ],
    "Bank Charges & Taxes": [
        "charges", "annualfee", "smschg", "penalty", "bank fee", "service charge", "gst",
        "min bal", "maintenance fee", "ledger fee", "processing fee", "forex markup",
    ],
}
TOKENS_CREDIT_ONLY = ["Salary & Income"]
TOKENS_NOT_CREDIT = ["Loan EMI & Credit Card", "Bank Charges & Taxes", "Utilities & Bills"]

# Word patterns per category with the money direction they need, in evaluation
# order. Each pattern is matched as a whole word on the lower-cased narration.
WORD_RULES = [
    ("Salary & Income", "CREDIT", [
        r"salary", r"payroll", r"sal\s+cr", r"ach\s+cr", r"interest\s+p(?:ai)?d", r"int\.pd",
        r"dividend", r"bonus", r"reimbursement", r"stipend",
    ]),
    ("Groceries & Supermarkets", "DEBIT", [
        r"blinkit", r"zepto", r"bigbasket", r"dmart", r"reliance\s*(?:fresh|smart|retail)",
        r"spencer(?:s)?", r"nature'?s\s*basket", r"grocery", r"supermarket", r"vegetable",
        r"fruit", r"milk", r"dairy", r"more\s*retail", r"instamart",
    ]),
    ("Food & Dining", "DEBIT", [
        r"zomato", r"swiggy", r"mcdonald", r"domino", r"pizza", r"burger", r"kfc", r"subway",
        r"starbucks", r"cafe", r"restaurant", r"bakery", r"dhaba", r"chaayos", r"chai\s*point",
        r"eatery", r"kitchen", r"barbeque", r"hotel", r"food",
    ]),
    ("Utilities & Bills", "DEBIT", [
        r"bescom", r"mseb", r"tneb", r"electricity", r"power\s*corp", r"water\s*board",
        r"wssb", r"gas\s*bill", r"indane", r"hp\s*gas", r"bharat\s*gas", r"adani\s*gas",
        r"mahanagar\s*gas", r"airtel", r"jio", r"vodafone", r"vi\s*bill", r"broadband",
        r"act\s*fiber", r"tata\s*play", r"dish\s*tv", r"billdesk", r"bill\s*pay", r"recharge",
    ]),
    ("Shopping & E-Commerce", "DEBIT", [
        r"amazon", r"flipkart", r"myntra", r"ajio", r"meesho", r"nykaa", r"tata\s*cliq",
        r"ebay", r"zara", r"h&m", r"lifestyle", r"westside", r"shoppers\s*stop", r"uniliver",
        r"decathlon", r"retail", r"ecom", r"fashion", r"mall",
    ]),
    ("Travel & Fuel", "DEBIT", [
        r"uber", r"ola", r"rapido", r"irctc", r"makemytrip", r"goibibo", r"yatra",
        r"cleartrip", r"indigo", r"air\s*india", r"spicejet", r"akasa", r"petrol", r"diesel",
        r"fuel", r"hpcl", r"iocl", r"bpcl", r"shell", r"toll", r"fastag", r"auto\s*fare",
        r"metro",
    ]),
    ("Healthcare & Medical", "DEBIT", [
        r"apollo", r"pharmeasy", r"1mg", r"netmeds", r"hospital", r"clinic", r"pharmacy",
        r"chemist", r"medical", r"doctor", r"healthcare", r"lab", r"pathology", r"medplus",
        r"dental",
    ]),
    ("Entertainment & OTT", "DEBIT", [
        r"netflix", r"spotify", r"prime\s*video", r"hotstar", r"disney", r"bookmyshow", r"pvr",
        r"inox", r"cinema", r"theatre", r"youtube\s*prem", r"apple\.com/bill",
        r"google\s*play", r"gaming", r"playstation", r"steam",
    ]),
    ("Investments & Trading", "ANY", [
        r"zerodha", r"groww", r"upstox", r"angel\s*one", r"mutual\s*fund", r"sip", r"nse",
        r"bse", r"camsonline", r"kfintech", r"indmoney", r"ppf", r"nps", r"coin",
        r"securities",
    ]),
    ("Loan EMI & Credit Card", "DEBIT", [
        r"cred", r"credit\s*card", r"cc\s*pay(?:ment)?", r"emi", r"loan", r"bajaj\s*finance",
        r"hdfc\s*card", r"sbi\s*card", r"icici\s*card", r"axis\s*card", r"home\s*loan",
        r"car\s*loan", r"auto\s*loan", r"personal\s*loan", r"finance",
    ]),
    ("Cash & ATM Withdrawal", "ANY", [
        r"atm\s*w(?:d)?l", r"cash\s*w(?:d)?l", r"nfs\s*w(?:d)?l", r"cash\s*deposit", r"cwdr",
        r"self\s*wdl", r"branch\s*cash", r"atm",
    ]),
    ("Bank Charges & Taxes", "DEBIT", [
        r"chg", r"charges", r"gst", r"annual\s*fee", r"sms\s*ch(?:g|arge)", r"min\s*bal",
        r"penalty", r"debit\s*card\s*fee", r"consolidated\s*chg", r"interest\s*debit", r"tds",
    ]),
]

# Words that mean a transfer, confidence of every rule outcome.
TRANSFER_WORDS = ["upi", "imps", "neft", "transfer"]
RULE_CONFIDENCE = 0.95
TRANSFER_CONFIDENCE = 0.75
OTHER_DEPOSIT_CONFIDENCE = 0.60
MISC_CONFIDENCE = 0.50
HEURISTIC_TRUST = 0.90
MODEL_TRUST = 0.70

# Payment channels, first hit wins (any letter case, whole words).
CHANNELS = [
    (r"upi", "UPI"),
    (r"neft", "NEFT"),
    (r"imps", "IMPS"),
    (r"rtgs", "RTGS"),
    (r"atm|nfs|cwdr", "ATM Cash"),
    (r"pos|edc|debit card", "POS / Card"),
    (r"ach|nach|ecs", "ACH / Mandate"),
    (r"chq|cheque|inward clg|outward clg", "Cheque"),
    (r"int\.pd|interest", "Interest"),
]
DEFAULT_CHANNEL = "Internal / NetBanking"

# Known merchant names and the two payee patterns.
MERCHANT_BRANDS = [
    "ZOMATO", "SWIGGY", "BLINKIT", "ZEPTO", "BIGBASKET", "DMART", "AMAZON", "FLIPKART",
    "MYNTRA", "AJIO", "MEESHO", "NYKAA", "UBER", "OLA", "RAPIDO", "IRCTC", "MAKEMYTRIP",
    "INDIGO", "AIR INDIA", "NETFLIX", "SPOTIFY", "BOOKMYSHOW", "PVR", "INOX", "ZERODHA",
    "GROWW", "CRED", "APOLLO", "PHARMEASY", "1MG", "BESCOM", "AIRTEL", "JIO",
]
MERCHANT_UPI = r"UPI/(?:[A-Z0-9]+/)?([A-Za-z0-9\s_\.\-]+?)/(?:UPI|Payment|Ref|DR|CR)"
MERCHANT_PAYEE = r"(?:TO|FROM|PAY TO)\s+([A-Za-z0-9\s]{3,25})"

# Clearing-code prefixes and the issuer each belongs to.
CLEARING_PREFIXES = {
    "HDFC": "HDFC Bank",
    "SBIN": "State Bank of India (SBI)",
    "ICIC": "ICICI Bank",
    "UTIB": "Axis Bank",
    "KKBK": "Kotak Mahindra Bank",
    "BARB": "Bank of Baroda",
    "PUNB": "Punjab National Bank (PNB)",
    "CNRB": "Canara Bank",
    "UBIN": "Union Bank of India",
    "YESB": "Yes Bank",
    "INDB": "IndusInd Bank",
    "IDFB": "IDFC FIRST Bank",
    "FDRL": "Federal Bank",
    "BKID": "Bank of India",
    "IDIB": "Indian Bank",
    "CBIN": "Central Bank of India",
    "SCBL": "Standard Chartered Bank",
    "CITI": "Citibank",
    "HSBC": "HSBC Bank",
    "RATN": "RBL Bank",
    "BDBL": "Bandhan Bank",
    "DBSS": "DBS Bank",
    "IOBA": "Indian Overseas Bank",
    "MAHB": "Bank of Maharashtra",
    "KVBL": "Karur Vysya Bank",
    "CSBK": "CSB Bank",
    "SIBL": "South Indian Bank",
    "TMBL": "Tamilnad Mercantile Bank",
    "AUBL": "AU Small Finance Bank",
    "ESFB": "Equitas Small Finance Bank",
    "UJVN": "Ujjivan Small Finance Bank",
}
GENERIC_ISSUER = "Universal Bank / Financial Institution"
GENERIC_ISSUERS = ["Generic Bank", "Generic / Other Bank", GENERIC_ISSUER]

# Document types.
TEXT_DOCUMENT = "Text-based PDF"
IMAGE_DOCUMENT = "Image-based PDF (OCR)"
LOCKED_DOCUMENT = "Password-Protected PDF"
LOCKED_BANK = "Encrypted / Password Protected"
LOCKED_NOTE = (
    "This PDF bank statement is password-protected. Please unlock or decrypt the PDF before processing."
)
MIN_PAGE_CHARS = 60
SAMPLE_CHARS = 3000

# Method labels of the three labelling modes.
METHOD_HEURISTIC_MODE = "Heuristic (Rule-Based)"
METHOD_ML_MODE = "Machine Learning (TF-IDF + LogReg)"
METHOD_HYBRID_RULES = "Heuristic Rule-Based"
METHOD_HYBRID_MODEL = "Traditional ML Model"
METHOD_OVERRIDE = "Manual Override"
