"""Training texts: seed narrations of our own, variants of them, and the split for testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, scan

# Bank names of our own for the envelopes.
BANKS = ["HARBOUR", "MERIDIAN", "CEDAR", "LAGOON", "SUMMIT"]
MULTIPLIER = 15
TEST_SHARE = 0.2
SEED = 42

# Seed narrations of our own, by category.
SEEDS = {
    "Salary & Income": [
        "NEFT CR MONTHLY SALARY ORCHARD SOFTWARE", "ACH CR PAYROLL BLUE RIVER LOGISTICS",
        "SALARY CREDIT FOR MARCH", "INTEREST PAID ON SAVINGS BALANCE", "DIVIDEND FROM STEEL HOLDINGS",
        "YEARLY BONUS CREDIT", "TRAVEL COST REIMBURSEMENT", "STIPEND FOR RESEARCH FELLOW",
    ],
    "Groceries & Supermarkets": [
        "POS FRESH BASKET SUPERMARKET", "UPI BLINKIT QUICK ORDER", "WEEKLY VEGETABLE MARKET",
        "DAIRY AND MILK SUBSCRIPTION", "KIRANA STORE CORNER STREET", "ZEPTO EVENING GROCERY",
        "BIGBASKET MONTHLY PROVISIONS", "DMART HOUSEHOLD STORE",
    ],
    "Food & Dining": [
        "ZOMATO LUNCH ORDER", "SWIGGY DINNER DELIVERY FOOD", "COFFEE HOUSE CAFE", "PIZZA CORNER RESTAURANT",
        "HIGHWAY DHABA MEALS", "BAKERY BIRTHDAY CAKE", "BURGER POINT FOOD COURT", "HOTEL BREAKFAST BUFFET",
    ],
    "Utilities & Bills": [
        "ELECTRICITY BOARD BILL PAYMENT", "AIRTEL BROADBAND MONTHLY BILL", "JIO PREPAID RECHARGE",
        "CITY WATER BOARD CHARGES", "PIPED GAS BILL", "DISH TV YEARLY PACK", "VODAFONE POSTPAID BILLPAY",
        "BILLDESK POWER CORP PAYMENT",
    ],
    "Shopping & E-Commerce": [
        "AMAZON ONLINE ORDER", "FLIPKART SALE PURCHASE", "MYNTRA FASHION CLOTHING", "DECATHLON SPORTS SHOP",
        "NYKAA BEAUTY ORDER", "ELECTRONICS SHOWROOM TV", "FOOTWEAR BOUTIQUE MALL", "AJIO APPAREL RETURN EXCHANGE",
    ],
    "Travel & Fuel": [
        "UBER CITY RIDE", "OLA AIRPORT CAB", "PETROL PUMP FUEL", "IRCTC TRAIN TICKET", "INDIGO FLIGHT BOOKING",
        "FASTAG TOLL TOPUP", "METRO CARD RECHARGE COUNTER", "DIESEL FILLING STATION",
    ],
    "Healthcare & Medical": [
        "APOLLO PHARMACY MEDICINES", "CITY HOSPITAL CONSULTATION", "DENTAL CLINIC VISIT", "PATHOLOGY LAB TEST",
        "PHARMEASY ORDER", "EYE DOCTOR OPTICALS", "CHEMIST SHOP BILL", "HEALTHCARE CHECKUP PACKAGE",
    ],
    "Entertainment & OTT": [
        "NETFLIX MONTHLY PLAN", "SPOTIFY MUSIC PREMIUM", "BOOKMYSHOW CINEMA TICKETS", "HOTSTAR YEARLY STREAMING",
        "PVR MOVIE NIGHT", "YOUTUBE PREMIUM", "GAMING CONSOLE STORE CREDIT", "AMUSEMENT PARK ENTRY",
    ],
    "Investments & Trading": [
        "GROWW SIP INSTALMENT", "ZERODHA BROKING FUNDS", "MUTUAL FUND PURCHASE", "NSE CLEARING SETTLEMENT",
        "PPF ANNUAL DEPOSIT", "UPSTOX TRADING ACCOUNT", "STOCK BROKER PAYIN", "GOVERNMENT SECURITIES AUCTION",
    ],
    "Loan EMI & Credit Card": [
        "HOME LOAN EMI", "CAR LOAN INSTALLMENT", "CREDIT CARD BILL PAYMENT", "PERSONAL LOAN EMI ACH",
        "CRED CARD DUES", "MORTGAGE MONTHLY DUE", "BAJAJ FINANCE EMI", "EDUCATION LOAN REPAYMENT",
    ],
    "Cash & ATM Withdrawal": [
        "ATM WDL MAIN STREET", "CASH WITHDRAWAL BRANCH", "NFS ATM CASH", "SELF CASH CHEQUE", "CASH DEPOSIT MACHINE",
        "CWDR OTHER BANK ATM", "ATM CASH AIRPORT", "BRANCH CASH COUNTER",
    ],
    "Bank Charges & Taxes": [
        "SMS ALERT CHARGES", "ANNUAL CARD FEE", "GST ON SERVICE", "MIN BAL PENALTY", "LOCKER RENT CHG",
        "TDS ON INTEREST", "PROCESSING FEE", "CHEQUE RETURN CHARGES",
    ],
    "Transfer (P2P / Self)": [
        "IMPS TO FRIEND", "NEFT TRANSFER TO SISTER", "SELF ACCOUNT TRANSFER", "UPI TO LANDLORD RENT SHARE",
        "RTGS VENDOR SETTLEMENT", "FUND TRANSFER JOINT ACCOUNT", "IMPS FAMILY SUPPORT", "INTERNAL TRANSFER LINKED ACCOUNT",
    ],
}


def seed_corpus(spark: SparkSession) -> DataFrame:
    rows = [(c, t) for c, texts in SEEDS.items() for t in texts]
    return spark.createDataFrame(rows, "category string, description string")


def _digits(salt: str, count: int) -> Column:
    """``count`` digits that depend on the text and the variant number only."""
    h = F.md5(F.concat_ws("|", F.lit(salt), "description", F.col("variant").cast("string")))
    number = F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % 10**count
    return F.lpad(number.cast("string"), count, "0")


def _choice(salt: str, n: int) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(salt), "description", F.col("variant").cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def augment(seeds: DataFrame, multiplier: int = MULTIPLIER) -> DataFrame:
    """Each text and ``multiplier`` variants of it in payment envelopes (``variant`` 0 is the text).

    Choices come from a hash of the text and the variant, so a lost task gives the same rows
    again. One explode, no shuffle.
    """
    rows = seeds.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(multiplier))))
    text = F.col("description")
    ref = _digits("ref", 12)
    bank = F.element_at(F.array(*[F.lit(b) for b in BANKS]), (_choice("bank", len(BANKS)) + 1).cast("int"))
    branch = (_choice("branch", 900) + 100).cast("string")
    kind = _choice("kind", 4)
    variant = (
        F.when(F.col("variant") == 0, text)
        .when(kind == 0, F.concat(bank, F.lit(" ONLINE "), text, F.lit(" NO "), ref))
        .when(kind == 1, F.concat(F.lit("TRF "), ref, F.lit(" BR "), branch, F.lit(" "), text))
        .when(kind == 2, F.concat(F.lit("CARD XX"), F.substring(ref, 1, 4), F.lit(" "), text, F.lit(" AT "), bank))
        .otherwise(F.concat(F.lit("ENTRY "), F.substring(ref, 1, 9), F.lit(": "), text))
    )
    return rows.withColumn("description", variant)


def hash_digits(n: int) -> int:
    """Hexadecimal digits that cut ``n`` rows into blocks of at most BLOCK_ROWS rows on average."""
    digits = 1
    while n > BLOCK_ROWS * 16**digits:
        digits += 1
    return digits


def stratified_split(rows: DataFrame, label: str, key: str, *, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: the same share of every label, chosen by a hash of the key.

    A label may hold most rows, so its ranks are counted in blocks of hash prefixes, long enough
    for a block to hold some BLOCK_ROWS rows however many there are.
    """
    digits = hash_digits(rows.count())
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_block", F.conv(F.substring("_hash", 1, digits), 16, 10).cast("long"))
    one = F.lit(1).cast("long")
    ranked = scan(
        hashed, [label], ["_hash", key], block="_block", sums={"_rank": one}, whole={"_n": one}
    )
    return ranked.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_n") * share + 0.5)).drop(
        "_hash", "_block", "_rank", "_n"
    )
