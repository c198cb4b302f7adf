"""Word lists and lookup tables of the engine.

All are fixed values: results depend on exactly these entries.
"""

from __future__ import annotations

# -- normalisation (fixed values) --
DOUBLE_QUOTES = "“”„‟«»「」『』"
SINGLE_QUOTES = "‘’‚‛"
HYPHENS = "‐‑‒–—―−﹘﹣"
ZERO_WIDTH = "​‌‍﻿⁠"
FULLWIDTH_FIRST, FULLWIDTH_LAST, FULLWIDTH_SHIFT = 0xFF01, 0xFF5E, 0xFEE0
IDEOGRAPHIC_SPACE = "　"

# -- months (fixed values) --
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_SHORT = {"Sept": 9} | {m[:3]: k for k, m in enumerate(MONTHS, 1)}

# -- roles that are no names (fixed values) --
ROLES_EN = (
    "party", "parties", "plaintiff", "defendant", "claimant", "respondent", "appellant", "appellee", "client", "customer",
    "company", "corporation", "individual", "person", "entity", "agent", "representative", "attorney", "counsel", "lawyer",
    "licensor", "licensee", "franchisor", "franchisee", "lessor", "lessee", "landlord", "tenant", "buyer", "seller",
    "purchaser", "vendor", "creditor", "debtor", "guarantor", "surety", "assignor", "assignee", "transferor", "transferee",
    "employer", "employee", "contractor", "subcontractor", "principal", "trustee", "beneficiary", "fiduciary", "discloser",
    "recipient", "court", "courts",
)
ROLES_KO = (
    "당사자", "갑", "을", "병", "정", "본인", "상대방", "원고", "피고", "신청인", "피신청인", "항소인", "피항소인", "의뢰인", "고객", "회사", "법인",
    "개인", "대리인", "위임자", "수임자", "임차인", "임대인", "매수인", "매도인", "채권자", "채무자", "보증인", "피보증인", "수탁자", "위탁자", "양도인",
    "양수인", "발주자", "수급인", "하도급인", "사용자", "근로자", "피용자", "고용주", "저작권자", "이용자", "실시권자", "특허권자", "대표", "대표이사",
    "이사", "감사", "주주", "당사",
)
ARTICLES_EN = ("the", "a", "an")

# -- words that stand for a defined party (fixed values) --
DEFINED_ROLES = (
    "Buyer", "Seller", "Purchaser", "Vendor", "Licensor", "Licensee", "Discloser", "Recipient", "Company", "Client", "Customer",
    "Employer", "Employee", "Contractor", "Agent", "Principal", "Party", "Parties", "Project", "Supplier", "Distributor",
    "Manufacturer", "Lessor", "Lessee", "Landlord", "Tenant", "Investor", "Issuer", "Borrower", "Lender", "Subcontractor",
    "Guarantor", "Grantor", "Grantee", "Assignor", "Assignee", "매수인", "매도인", "갑", "을", "병", "정", "공급자", "수급자", "도급인",
    "수급인", "발주자", "수주자", "임대인", "임차인", "대여자", "차용자", "위탁자", "수탁자", "양도인", "양수인", "채권자", "채무자", "甲", "乙",
    "丙", "丁",
)
DEFINED_PREFIXES = ("the ", "The ")

# -- headings that are no keywords (fixed values) --
STOP_WORDS = (
    "Section", "Article", "Schedule", "Exhibit", "Annex", "Appendix", "Attachment", "Clause", "Recital", "Recitals", "Preamble",
    "Definitions", "Whereas", "별표", "부속서", "별첨", "첨부", "전문", "정의",
)
STOP_FORMS = (
    r"제 ?[0-9]+ ?조", r"제 ?[0-9]+ ?장", r"제 ?[0-9]+ ?항", r"별표 ?[0-9]+", r"부속서 ?[0-9]+",
    r"(?:Section|Article|Schedule|Exhibit|Annex|Appendix|Clause) [0-9IVXLCDM]+(?:\.[0-9]+)*[A-Z]?",
)

# -- names from mail domains (fixed values) --
TOP_DOMAINS = ("com", "org", "net", "co", "io", "kr", "jp", "cn", "uk", "de", "fr", "au", "ca", "in", "biz", "info", "us", "eu")
OFFICE_MAILBOXES = ("legal", "ceo", "cfo", "coo", "cto", "info", "hr", "admin", "office", "support", "contact", "sales", "billing", "accounts")

# -- company endings for variants of a name (fixed values) --
COMPANY_ENDINGS = (
    "Corporation", "Corp", "Corp.", "Incorporated", "Inc", "Inc.", "Limited", "Ltd", "Ltd.", "Company", "Co", "Co.", "LLC", "L.L.C.",
    "LLP", "L.L.P.", "PLC", "AG", "GmbH", "S.A.",
)

# -- package parts (fixed values) --
METADATA_FIELDS = ("creator", "lastModifiedBy", "lastPrinted", "title", "subject", "keywords", "description", "Company", "Manager", "Template")
METADATA_PARTS = ("docProps/core.xml", "docProps/app.xml")
CUSTOM_PROPERTIES = "docProps/custom.xml"
COMMENT_PARTS = ("word/comments.xml", "word/commentsExtended.xml", "word/commentsExtensible.xml", "word/commentsIds.xml", "word/people.xml")
FIXED_SCOPES = (("body", "word/document.xml"), ("footnotes", "word/footnotes.xml"), ("endnotes", "word/endnotes.xml"), ("comments", "word/comments.xml"))

# -- identifier kinds and their labels (fixed values) --
KIND_OF = {"korean-rrn": "rrn", "korean-brn": "brn", "us-ein": "ein", "phone-kr": "phone-kr", "phone-intl": "phone-intl", "email": "email", "account-kr": "account-kr", "credit-card": "card", "phone-kr-landline": "phone-kr-landline"}
