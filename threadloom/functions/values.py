"""Vocabularies, patterns, thresholds and texts that results depend on.

They are a specification and stay as they are, quirks included: stems such as "substitut"
only match as whole words, "court" also fires inside "courtesy".
"""

# fixed values: patterns
URL = r"https?://\S+|www\.\S+|\bt\.co/\S+"
REDIRECT_PHRASES = [
    "dm us", "dm you", "dm me", "send us a dm", "send a dm", "shoot us a dm", "pls dm",
    "please dm", "drop us a dm", "send us a private message", "private message", "send us a pm",
    "send us a message", "message us", "direct message", "click 'message'", "click message",
    "follow us", "follow and dm", "reach out via", "in a dm", "via dm", "send us your details",
    "sent you a dm", "check your dm", "we've dm'd", "we have dm",
]
ACTIONABLE_TERMS = [
    "try", "settings", "update", "reset", "restart", "reboot", "reinstall", "password",
    "refund", "refunded", "track", "tracking", "order", "email", "link", "step", "steps",
    "check", "confirm", "account", "code", "status", "upgrade", "cancel", "replace",
    "replacement", "credit", "voucher", "dispatch", "delivery", "delivered", "payment",
    "charge", "charged", "invoice", "verify", "app", "version", "browser", "clear cache",
    "sim", "network", "coverage", "book", "booking", "flight", "seat", "gate",
    "sorted", "resolved", "fixed", "here's", "here is", "you can", "please go to", "visit",
]
SHORT_REPLY_WORDS = 6
SHORT_MESSAGE_WORDS = 4
#: Literals that a CSV scan reads as missing, besides the empty string.
MISSING = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
           "None", "n/a", "nan", "null"]

# fixed values: intent rules, in taxonomy order
OTHER = "other_or_unclear"
RULES = {
    "clubcard_or_loyalty": r"\b(clubcard|club card|loyalty|reward|points|nectar)\b",
    "missing_or_incorrect_item": r"\b(missing|substitut|replaced|wrong item|incorrect item|wrong order|item[s]? missing|didn'?t (get|receive)|not received|never received|damaged|squashed|smashed|short[- ]?dated|out of date item|missing item)\b",
    "delivery_issue": r"\b(deliver|delivery|delivered|driver|slot|didn'?t (arrive|turn up|show)|not (arrived|delivered|turned up)|no.show|late|arrive|dispatch|courier|van|redeliver|delivery date)\b",
    "online_order_issue": r"\b(online order|grocery order|my order|order number|place an order|placing an order|amend|cancel (my )?order|checkout|basket|order (didn'?t|won'?t|hasn'?t)|orders?)\b",
    "product_availability": r"\b(out of stock|in stock|stock|sold out|unavailable|availab\w*|when (will|are) .* back|restock|discontinu|not available|no longer (sell|stock))\b",
    "refund_or_payment": r"\b(refund|refunded|money back|reimburse|overcharg|over charged|charged (me|twice)?|double charged|payment|paid|declined|voucher|gift card|e[- ]?coupon|debited|card (declined|payment))\b",
    "account_or_technical_issue": r"\b(log ?in|log ?in|sign ?in|password|reset|account|website|web site|app|site|error|crash|glitch|not working|won'?t load|can'?t (log|access|sign))\b",
    "store_experience": r"\b(store|branch|shop|in[- ]?store|staff|colleague|manager|queue|till|checkout|car ?park|petrol|fuel|express|superstore|metro|aisle|shelf)\b",
    "complaint": r"\b(complaint|complain|disgusting|appalling|disgrace|disgraceful|worst|terrible|awful|rubbish|shocking|fuming|furious|mould|mouldy|rotten|inedible|expired|out of date|poor (service|quality)|disappointed|unhappy|rude|unacceptable)\b",
    "general_information": r"\b(how do i|how can i|how much|can i|could you|do you (have|sell|know|do)|is there|are there|what time|opening (times|hours)|when (do|are|is) you|what (is|are)|where (can|is|do)|price of|question|enquir|query|info(rmation)?)\b",
}
TAXONOMY_ORDER = [*RULES, OTHER]
AGENT_ORDER = [
    "clubcard_or_loyalty", "missing_or_incorrect_item", "refund_or_payment", "account_or_technical_issue", "delivery_issue",
    "online_order_issue", "product_availability", "store_experience", "complaint", "general_information", OTHER,
]
STRONG_PHRASES = {
    "clubcard_or_loyalty": ["clubcard", "club card", "loyalty points"],
    "missing_or_incorrect_item": ["missing item", "items missing", "item missing", "wrong item", "incorrect item", "missing half"],
    "refund_or_payment": ["charged twice", "double charged", "duplicate charge", "want a refund", "overcharged", "money back"],
    "delivery_issue": ["never arrived", "hasn't arrived", "has not arrived", "delivery slot", "not been delivered", "didn't arrive"],
    "online_order_issue": ["online order", "checkout", "my basket", "order confirmation"],
    "product_availability": ["out of stock", "in stock", "back in stock", "sold out"],
    "account_or_technical_issue": ["can't log in", "cant log in", "reset my password", "locked out", "website not working", "app not working"],
    "store_experience": ["self checkout", "at the till", "in store", "tesco express"],
    "complaint": ["formal complaint", "poor service", "terrible service", "unacceptable"],
    "general_information": ["opening hours", "nearest store", "how do i", "do you offer"],
}
HIGH, MEDIUM = 80, 55  # confidence bands, in hundredths

# fixed values: escalation
HUMAN_REQUEST = ["speak to a human", "speak to someone", "talk to someone", "talk to a person", "real person", "real human", "human agent",
                 "speak to an advisor", "speak to a representative", "want a person", "speak to a manager"]
LEGAL = ["legal action", "take legal", "solicitor", "lawyer", "ombudsman", "trading standards", "sue you", "take you to court", "court"]
UNRESOLVED = ["still not", "still missing", "still waiting", "still haven't", "still no", "nobody has helped", "no one has helped",
              "no-one has helped", "been ignored", "second time", "third time", "again and again", "weeks ago", "keep contacting"]
PAYMENT = ["charged twice", "double charged", "duplicate charge", "overcharged", "refund", "money back", "charged me twice", "took the money"]
ACCOUNT = ["can't log in", "cant log in", "can't login", "cant login", "locked out", "account access", "reset my password", "hacked",
           "can't access my account"]
LIVE_ORDER = ["delivery_issue", "missing_or_incorrect_item", "online_order_issue"]
REASONS = {
    "human": "Customer explicitly requested human support.",
    "legal": "Legal or safety concern; recommend human review.",
    "payment": "Payment or refund issue requires account-level verification; the agent cannot process refunds.",
    "account": "Account access issue requires identity verification.",
    "unresolved": "Repeated or unresolved issue detected.",
    "live": "Request requires live order information.",
    "unclear": "Low-confidence or unclear intent; recommend human review.",
    "none": "No escalation signals detected; suitable for an automated draft reply.",
}

# fixed values: brand analysis
ENGLISH = r"\b(?:the|you|your|and|for|please|not|with|have|this|that|are|is|to|my|me|we|it|of|on|in|can|will|i|a|do|no|why|how|when|what|get|got|need|help|been|was|but|so|if|at)\b"
CATEGORIES = {
    "account_login": r"\b(?:account|log ?in|login|sign ?in|signin|password|locked|verify|verification|otp|username|credential)\b",
    "payment_billing": r"\b(?:payment|pay|bill|billing|charge|charged|invoice|card|overcharge|debit)\b",
    "refund": r"\b(?:refund|money back|reimburse|chargeback)\b",
    "cancellation": r"\b(?:cancel|cancelled|canceled|cancellation|unsubscribe|terminate)\b",
    "delivery_order": r"\b(?:order|delivery|deliver|delivered|package|parcel|shipping|shipment|dispatch|courier|track|tracking)\b",
    "technical_issue": r"\b(?:not working|doesn'?t work|won'?t|error|bug|crash|crashing|broken|glitch|freeze|frozen|stuck|fault)\b",
    "outage": r"\b(?:down|outage|offline|no service|no signal|can'?t connect|not connecting|server)\b",
    "subscription": r"\b(?:subscription|subscribe|subscribed|plan|renew|renewal|premium|membership|trial)\b",
    "travel_booking": r"\b(?:flight|booking|book|delayed|delay|gate|boarding|seat|baggage|luggage|train|ticket|reschedule|check ?in)\b",
    "complaint": r"\b(?:worst|terrible|awful|disappointed|disappointing|ridiculous|unacceptable|complaint|rubbish|furious|angry)\b",
    "info_request": r"\b(?:how do i|how to|how can i|can i|when will|what is|where is|do you|is there)\b",
    "product_issue": r"\b(?:screen|battery|volume|sound|charging|charger|device|phone|headphone|controller|game|hardware|button)\b",
}
USABLE_TARGET, GOLDEN_TARGET, TEST_SHARE, SOFT_REPLIES, HARD_REPLIES = 5000, 250, 0.15, 60_000, 200_000
WEIGHTS = {
    "groundability": 0.30, "usable_volume": 0.20, "intent_diversity": 0.15, "multi_turn": 0.10, "data_quality": 0.10,
    "golden_capacity": 0.10, "reproducibility": 0.05,
}

# fixed values: word counts, sampling, retrieval, agent
STOPWORDS = """
a an the and or but if then so of to in on at for with from by as is are was were be been being
i you he she it we they me my your our their his her its this that these those there here what which
who whom whose when where why how do does did doing have has had having will would can could should
shall may might must not no yes im ive dont cant wont didnt doesnt isnt arent id ill ive u ur ya youre
just get got getting one now still back going go get like really very much more most any some out up
down off over please pls thanks thank hi hello hey oh ok okay amp via dm rt http https co tesco
""".split()
PER_INTENT, MOST_GOLDEN = 12, 150
TOP_UPS = {"short": 10, "multi_turn": 10, "ambiguous": 10, "has_url": 5}
MIN_DF, MAX_DF, NGRAMS = 2, 0.9, 2
MAX_MESSAGE, MAX_EXAMPLE, MAX_PROMPT_MESSAGE, TOP_K = 2000, 240, 600, 5
MOCK_REPLY = "[MOCK RESPONSE] A customer-support response would be generated here."
STEPS = ["validate_input", "classify_intent", "escalation_policy", "retrieve_and_generate"]

#: What each label covers; wording of our own.
LABELS = {
    "clubcard_or_loyalty": "Loyalty points, rewards and membership cards",
    "missing_or_incorrect_item": "An order came with items missing, wrong or damaged",
    "delivery_issue": "A delivery is late, absent or hard to book",
    "online_order_issue": "Placing, changing or cancelling an order online",
    "product_availability": "Whether a product can be bought now or soon",
    "refund_or_payment": "Charges, payments and money to be returned",
    "account_or_technical_issue": "Signing in, the site and the app",
    "store_experience": "What happened in a branch",
    "complaint": "Dissatisfaction that no other label covers",
    "general_information": "A question about facts or services",
    OTHER: "Nothing above, or too little to tell",
}

# ---- fixed values: the quotas of queries to be read by eye, and the score from which a match counts as strong ----
QUALITATIVE = [("good_high_similarity", 2), ("weak_low_similarity", 2), ("weak_no_intent_match", 2), ("ambiguous_query", 2), ("short_query", 2),
               ("url_bearing_query", 1), ("multi_turn_query", 1), ("no_result_query", 1)]
STRONG_MATCH = 0.3

# ---- fixed values: settings of the live model client ----
TEMPERATURE, MAX_TOKENS, TIMEOUT_SECONDS, RETRIES = 0.2, 350, 30.0, 1

#: What belongs to a label, what doesn't, and what a reply should do.
SCOPE = {
    "clubcard_or_loyalty": ("points that were not added, lost vouchers, trouble with the card", "money back that has nothing to do with the scheme", "say which team keeps the scheme's accounts"),
    "missing_or_incorrect_item": ("absent, swapped, wrong or broken goods in a delivery", "an order that never came; goods that are out of stock", "say sorry and ask for the order in private"),
    "delivery_issue": ("late or failed deliveries, slots, drivers", "goods missing from a delivery that came", "ask for the slot and name the next step"),
    "online_order_issue": ("the basket, the checkout, changes and cancellations", "how an order travels; trouble with signing in", "lead through the step that fails"),
    "product_availability": ("sold out or delisted goods, when they return", "goods missing from a delivery", "say where stock can be looked up, without a promise"),
    "refund_or_payment": ("refunds, double charges, cards that are declined", "the cause behind it where that is the point", "send to the team that may see payments"),
    "account_or_technical_issue": ("passwords, errors, crashes", "the steps of an order; the loyalty scheme", "offer the usual remedies, then the technical team"),
    "store_experience": ("staff, queues, tills, parking, fuel", "orders placed online", "thank for it and pass it on to the branch"),
    "complaint": ("poor quality, anger in general", "a complaint about something another label names", "show regret and open a case"),
    "general_information": ("opening hours, prices, how things work", "any report of a fault", "answer, or say where the answer is"),
    OTHER: ("thanks, small talk, messages without context", "whatever a label above fits", "ask back, or hand over to a person"),
}
