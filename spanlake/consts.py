"""Fixed values of the annotation schema."""

#: Entity types by sensitivity tier. Fixed values.
HIGH = "National_Identification_Number Passport_Number Driving_License_Number Tax_Reference_Number Credit_Card_Numbers Account_Statements Password Religion Sex_Orientation Political_Party Trade_Union_Membership Crime PEP_Status Medical_Information Allergy_Information Date_of_Birth Address_Work Address_Personal Geolocation_Data Customer_Reference_Number Emergency_Contact_Details Building_Badge_Card_Number".split()
MEDIUM = "Full_Name First_Given_Name Last_Family_Name Preferred_Name Work_Email_Address Personal_Email_Address Telephone_Numbers_Work Telephone_Numbers_Personal Place_of_Birth Gender Marital_Status Nationality Citizenship_Status Compensation_and_Salary Static_IP_Address Social_Media_Identifiers Employee_ID_Number Performance_Assessment Disciplinary_Action Sickness_Day_Records Professional_Background".split()
LOW = "Age Country_of_Residence State City Location Business_Title Org_Name Date_Time".split()
TIERS = {t: name for name, types in (("HIGH", HIGH), ("MEDIUM", MEDIUM), ("LOW", LOW)) for t in types}
#: Types of special categories. Fixed values.
ARTICLE_9 = "Religion Sex_Orientation Political_Party Trade_Union_Membership Medical_Information Allergy_Information Crime".split()
#: Values of forms, modes and states. Fixed values.
FORMS = ("complete", "partial", "obfuscated")
MODES = ("coverage", "paired_sweep")
STATUSES = ("ok", "verified", "repaired", "failed")
#: What detectors call a type. Fixed values.
LABELS = {"PERSON": "Full_Name", "EMAIL_ADDRESS": "Work_Email_Address", "PHONE_NUMBER": "Telephone_Numbers_Personal", "CREDIT_CARD": "Credit_Card_Numbers", "IBAN_CODE": "Customer_Reference_Number", "IP_ADDRESS": "Static_IP_Address", "DATE_TIME": "Date_Time", "US_SSN": "National_Identification_Number", "US_DRIVER_LICENSE": "Driving_License_Number", "US_PASSPORT": "Passport_Number", "LOCATION": "Location", "ORGANIZATION": "Org_Name", "MEDICAL_LICENSE": "Medical_Information", "URL": "Social_Media_Identifiers", "NRP": "Nationality"}
#: Coarse labels of the models whose answers are spans by type. Fixed values.
COARSE_LABELS = (
    "PERSON ORGANIZATION LOCATION CITY STATE COUNTRY ADDRESS DATE_TIME DOB AGE JOB_POSITION SALARY PASSWORD RELIGION NATIONALITY POLITICAL_PARTY CRIME SEX_ORIENTATION EMAIL PHONE SSN"
).split()
#: What a zero-shot span model is asked for. Fixed values.
SPOKEN_LABELS = {
    "person name": "Full_Name",
    "first name": "First_Given_Name",
    "last name": "Last_Family_Name",
    "email address": "Work_Email_Address",
    "phone number": "Telephone_Numbers_Personal",
    "date of birth": "Date_of_Birth",
    "credit card number": "Credit_Card_Numbers",
    "national id number": "National_Identification_Number",
    "passport number": "Passport_Number",
    "address": "Address_Personal",
    "city": "City",
    "state": "State",
    "country": "Country_of_Residence",
    "organization": "Org_Name",
    "medical condition": "Medical_Information",
    "religion": "Religion",
    "political party": "Political_Party",
    "employee id": "Employee_ID_Number",
    "ip address": "Static_IP_Address",
    "social media handle": "Social_Media_Identifiers",
    "marital status": "Marital_Status",
    "gender": "Gender",
    "nationality": "Nationality",
}
#: Categories of types. Fixed values.
CATEGORIES = {
    "Name Family": "Full_Name First_Given_Name Last_Family_Name Preferred_Name Business_Title".split(),
    "Contact Information": "Address_Work Address_Personal Telephone_Numbers_Work Telephone_Numbers_Personal Work_Email_Address Personal_Email_Address".split(),
    "Demographic and Identity": "Date_of_Birth Age Place_of_Birth Gender Marital_Status Nationality Citizenship_Status Sex_Orientation Religion Political_Party".split(),
    "Geographic": "Country_of_Residence State City Location Geolocation_Data".split(),
    "Government IDs": "National_Identification_Number Passport_Number Driving_License_Number Tax_Reference_Number".split(),
    "Financial": "Compensation_and_Salary Credit_Card_Numbers Customer_Reference_Number Account_Statements".split(),
    "Employment and Organization": "Employee_ID_Number Building_Badge_Card_Number Performance_Assessment Disciplinary_Action Sickness_Day_Records Professional_Background Org_Name".split(),
    "Sensitive Compliance": "Crime PEP_Status Trade_Union_Membership".split(),
    "Health": "Allergy_Information Medical_Information".split(),
    "Digital and Other": "Social_Media_Identifiers Static_IP_Address Password Date_Time Emergency_Contact_Details".split(),
}
#: What hints at a pattern's language, in order. Fixed values.
LANGUAGE_TOKENS = {
    "EN": ("english", "western canonical", "us standard"),
    "FR": ("french", "français", "canadian french"),
    "DE": ("german", "deutsch"),
    "IT": ("italian", "italiano"),
    "ES": ("spanish", "español"),
    "PT": ("portuguese", "brazilian", "português"),
    "JA": ("japanese", "japan", "kanji", "hiragana", "katakana", "tokyo", "yamada"),
    "ZH": ("chinese", "hanzi", "pinyin", "traditional chinese", "simplified chinese"),
    "KO": ("korean", "hangul"),
    "AR": ("arabic", "ibn", "bint", "kunya", "nasab"),
    "HE": ("hebrew",),
    "TH": ("thai", "buddhist era"),
    "RU": ("russian", "cyrillic", "patronymic"),
    "TR": ("turkish",),
    "PL": ("polish",),
    "NL": ("dutch",),
    "CS": ("czech",),
    "HU": ("hungarian",),
    "SV": ("swedish",),
    "FI": ("finnish",),
    "NO": ("norwegian",),
    "DA": ("danish",),
    "EL": ("greek",),
    "HI": ("hindi", "devanagari"),
    "VI": ("vietnamese",),
    "IS": ("icelandic",),
}
#: Languages by priority. Fixed values.
LANGUAGE_TIERS = {
    "P1": ("EN", "FR", "DE", "IT", "ES", "PT_BR"),
    "P2": ("FR_CA", "JA", "NL"),
    "P3": ("SV", "FI", "CS", "HE", "HU", "KO", "NO", "PT_EU", "RU", "ZH_CN", "ZH_TW", "TH", "TR", "AR", "DA", "HI"),
}
#: Tokens of a character by language; others 0.25. Fixed values.
TOKEN_RATES = {"RU": 0.5, "ZH_CN": 1.0, "ZH_TW": 1.0, "JA": 1.0, "KO": 1.0, "TH": 1.5, "AR": 0.6, "HE": 0.5, "HI": 0.9}
#: Formats. Fixed values.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9][a-zA-Z0-9-]*(\.[a-zA-Z0-9][a-zA-Z0-9-]*)+$"
SSN = r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
#: Patterns that propose entities in plain text, by type.
PROPOSALS = {"Work_Email_Address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", "Static_IP_Address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "Credit_Card_Numbers": r"[0-9]{16}", "Password": r"[0-9a-f]{40}"}

#: Fields a record, its axes and its entities must have. Fixed values.
RECORD_FIELDS = "record_id mode axes target_entity_type target_pattern_id behavioral_frame text entities entity_count generation_status".split()
AXIS_FIELDS = "domain format difficulty length density code_switching language adjacency co_occurrence_pattern".split()
ENTITY_FIELDS = "entity_type entity_string mention_index disclosed disclosure_form sensitivity_tier".split()
ADJACENCY = ("none", "loose", "tight")
#: Types that identify directly, and those never to be disclosed. Fixed values.
DIRECT = "Full_Name First_Given_Name Last_Family_Name Preferred_Name Work_Email_Address Personal_Email_Address Telephone_Numbers_Work Telephone_Numbers_Personal National_Identification_Number Passport_Number Driving_License_Number Credit_Card_Numbers Password".split()
MUST_HIDE = "National_Identification_Number Passport_Number Driving_License_Number Credit_Card_Numbers Password Medical_Information Sex_Orientation Religion Crime".split()
#: Behavioural frames and their weights. Fixed values.
FRAMES = (("isolation", 0.40), ("co_occurrence", 0.15), ("hypothetical", 0.10), ("negation", 0.10), ("partial", 0.10), ("instructional", 0.08), ("cross_sentence", 0.07))
#: Other names of types; None drops the entity. Fixed values.
REMAP = {
    "Drivers_License_Number": "Driving_License_Number",
    "IP_Address": "Static_IP_Address",
    "IPv4_Address": "Static_IP_Address",
    "IPv6_Address": "Static_IP_Address",
    "Bank_Account_Number": "Account_Statements",
    "Financial_Account_Number": "Account_Statements",
    "IBAN_Code": "Account_Statements",
    "IBAN": "Account_Statements",
    "BIC": "Account_Statements",
    "Swift_Code": "Account_Statements",
    "VIN": "Customer_Reference_Number",
    "Postal_Code": "Location",
    "Zip_Code": "Location",
    "SSN": "National_Identification_Number",
    "ID_Card": "National_Identification_Number",
    "Tax_ID": "Tax_Reference_Number",
    "Phone_Number": "Telephone_Numbers_Personal",
    "Phone_Mobile": "Telephone_Numbers_Personal",
    "Mobile_Phone": "Telephone_Numbers_Personal",
    "Email_Address": "Personal_Email_Address",
    "Email_Personal": "Personal_Email_Address",
    "Email_Work": "Work_Email_Address",
    "Username": "Social_Media_Identifiers",
    "User_ID": "Social_Media_Identifiers",
    "Handle": "Social_Media_Identifiers",
    "Username_Handle": "Social_Media_Identifiers",
    "Online_Username": "Social_Media_Identifiers",
    "Online_Username_Handle": "Social_Media_Identifiers",
    "Online_Username_or_Handle": "Social_Media_Identifiers",
    "Username_or_Handle": "Social_Media_Identifiers",
    "Social_Media_Handle": "Social_Media_Identifiers",
    "Alias": "Social_Media_Identifiers",
    "Nickname": "Preferred_Name",
    "Middle_Name": "Full_Name",
    "Tax_Identification_Number": "Tax_Reference_Number",
    "Tax_ID_Number": "Tax_Reference_Number",
    "Tax_Number": "Tax_Reference_Number",
    "National_ID_Card_Number": "National_Identification_Number",
    "National_ID_Document_Number": "National_Identification_Number",
    "Drivers_Licence_Number": "Driving_License_Number",
    "Driver_License_Number": "Driving_License_Number",
    "License_Plate": "Driving_License_Number",
    "License_Plate_Number": "Driving_License_Number",
    "Vehicle_Registration_Number": "Driving_License_Number",
    "Vehicle_Registration": "Driving_License_Number",
    "Vehicle_Registration_Plate": "Driving_License_Number",
    "Vehicle_Plate_Number": "Driving_License_Number",
    "Vehicle_Plate": "Driving_License_Number",
    "Vehicle_License_Plate": "Driving_License_Number",
    "Vehicle_ID_Number": "Driving_License_Number",
    "Vehicle_ID": "Driving_License_Number",
    "Vehicle_Identifier": "Driving_License_Number",
    "Vehicle_Identification_Number": "Driving_License_Number",
    "Vehicle_Info": "Driving_License_Number",
    "Vehicle_Information": "Driving_License_Number",
    "Financial_Amount": "Compensation_and_Salary",
    "Financial_Transaction_Amount": "Compensation_and_Salary",
    "Financial_Transaction": "Account_Statements",
    "Financial_Information": "Account_Statements",
    "Financial_Account_Balance": "Account_Statements",
    "Bank_Account_Numbers": "Account_Statements",
    "Banking_Information": "Account_Statements",
    "Bank_Routing_Number": "Account_Statements",
    "Bank_Routing_Code": "Account_Statements",
    "IBAN_Number": "Account_Statements",
    "SWIFT_BIC_Code": "Account_Statements",
    "Cryptocurrency_Wallet": "Account_Statements",
    "Digital_Wallet_ID": "Account_Statements",
    "Credit_Card_CVV": "Credit_Card_Numbers",
    "Credit_Card_Expiry": "Credit_Card_Numbers",
    "Credit_Card_Expiration": "Credit_Card_Numbers",
    "PIN_Code": "Password",
    "PIN": "Password",
    "Password_or_PIN": "Password",
    "Password_or_Key": "Password",
    "API_Key": "Password",
    "API_Key_or_Secret": "Password",
    "Security_Question_Answer": "Password",
    "Country": "Country_of_Residence",
    "Country_of_Birth": "Place_of_Birth",
    "Zip_Postal_Code": "Address_Personal",
    "Address": "Address_Personal",
    "GPS_Coordinates": "Geolocation_Data",
    "Blood_Type": "Medical_Information",
    "Medical_Insurance_Number": "Medical_Information",
    "Medical_License_Number": "Medical_Information",
    "Allergy_Severity": "Allergy_Information",
    "Disability_Status": "Medical_Information",
    "Performance_Review": "Performance_Assessment",
    "Performance_Rating": "Performance_Assessment",
    "Professional_License_Number": "Professional_Background",
    "Educational_Record": "Professional_Background",
    "Education": "Professional_Background",
    "Test_Score": "Professional_Background",
    "Security_Clearance": "Professional_Background",
    "Org_Registration_Number": "Org_Name",
    "Org_Reference_Number": "Org_Name",
    "Device_ID": "Static_IP_Address",
    "Device_Identifier": "Static_IP_Address",
    "Device_ID_Number": "Static_IP_Address",
    "MAC_Address": "Static_IP_Address",
    "IMEI": "Static_IP_Address",
    "IMEI_Number": "Static_IP_Address",
    "Server_Name": "Static_IP_Address",
    "Server_IP_or_Hostname": "Static_IP_Address",
    "Port_Number": "Static_IP_Address",
    "Serial_Number": "Static_IP_Address",
    "Unique_Identifier": "Static_IP_Address",
    "Digital_Identifier": "Static_IP_Address",
    "Tracking_Number": "Customer_Reference_Number",
    "URL": "Social_Media_Identifiers",
    "Sexual_Orientation": "Sex_Orientation",
    "Gender_Identity": "Gender",
    "Gender_Sexuality": "Sex_Orientation",
    "Gender_and_Sexuality": "Sex_Orientation",
    "Political_Affiliation": "Political_Party",
    "Political_Opinion": "Political_Party",
    "Union_Membership": "Trade_Union_Membership",
    "Caste": "Religion",
    "Ethnic_Origin": None,
    "Physical_Description": None,
    "Physical_Characteristics": None,
    "Physical_Attribute": None,
    "Physical_Characteristic": None,
    "Physical_Identifying_Characteristic": None,
    "Family_Relationship": "Emergency_Contact_Details",
    "Number_of_Children": None,
    "Dietary_Restriction": None,
    "Ethnicity": None,
    "Race_Ethnicity": None,
    "Race": None,
    "Financial_Loss": None,
    "Currency_Amount": None,
    "Branch_Code": None,
}
#: Scenario texts by domain and format. Fixed values.
SCENARIOS = {
    ("healthcare", "plain_text"): "Clinical note about a patient's recent visit.",
    ("healthcare", "email"): "Email between two clinicians coordinating patient care.",
    ("healthcare", "chat_transcript"): "Chat between clinician and on-call nurse about a patient.",
    ("healthcare", "ticket_worknotes"): "Hospital IT ticket related to patient data access.",
    ("healthcare", "json_record"): "EHR system patient export.",
    ("healthcare", "key_value_pairs"): "Patient intake form fields.",
    ("healthcare", "log_entry"): "Hospital system audit log entry.",
    ("legal", "plain_text"): "A legal pleading or court document excerpt.",
    ("legal", "email"): "Email between counsel and client regarding a case.",
    ("legal", "chat_transcript"): "Internal legal-team chat about a case.",
    ("legal", "ticket_worknotes"): "Compliance ticket regarding a regulatory matter.",
    ("legal", "json_record"): "Case-management system record export.",
    ("legal", "key_value_pairs"): "Court filing intake form.",
    ("legal", "log_entry"): "Document-management system access log.",
    ("finance", "plain_text"): "Bank statement or financial advisory note.",
    ("finance", "email"): "Customer email regarding an account or transaction.",
    ("finance", "chat_transcript"): "Customer support chat about a bank account.",
    ("finance", "ticket_worknotes"): "Finance compliance investigation ticket.",
    ("finance", "json_record"): "KYC/AML system export.",
    ("finance", "key_value_pairs"): "Loan or account-opening form.",
    ("finance", "log_entry"): "Transaction-processing system log entry.",
    ("education", "plain_text"): "Academic record narrative or transcript note.",
    ("education", "email"): "Email between a student and registrar.",
    ("education", "chat_transcript"): "Student-advisor chat session.",
    ("education", "ticket_worknotes"): "Registrar support ticket.",
    ("education", "json_record"): "Student information system record.",
    ("education", "key_value_pairs"): "Course-registration form.",
    ("education", "log_entry"): "LMS access log entry.",
    ("government", "plain_text"): "Government memo or policy document excerpt.",
    ("government", "email"): "Citizen-government correspondence.",
    ("government", "chat_transcript"): "Internal agency chat about a case file.",
    ("government", "ticket_worknotes"): "Government IT system support ticket.",
    ("government", "json_record"): "Government registry record.",
    ("government", "key_value_pairs"): "Government application form.",
    ("government", "log_entry"): "Border-control or registry log entry.",
    ("technology", "plain_text"): "Internal product spec or design doc excerpt.",
    ("technology", "email"): "Engineering team correspondence.",
    ("technology", "chat_transcript"): "Slack/Teams chat between engineers.",
    ("technology", "ticket_worknotes"): "JIRA / Anonymous Institution incident ticket.",
    ("technology", "json_record"): "User profile or analytics record.",
    ("technology", "key_value_pairs"): "Onboarding form for an internal tool.",
    ("technology", "log_entry"): "Application or auth-service log entry.",
    ("HR", "plain_text"): "HR memo or employee performance review.",
    ("HR", "email"): "Email between HR and an employee.",
    ("HR", "chat_transcript"): "Manager-employee one-on-one chat.",
    ("HR", "ticket_worknotes"): "HR support ticket.",
    ("HR", "json_record"): "HRIS employee record export.",
    ("HR", "key_value_pairs"): "Onboarding or benefits-enrollment form.",
    ("HR", "log_entry"): "Time-and-attendance system log.",
    ("insurance", "plain_text"): "Insurance claim narrative.",
    ("insurance", "email"): "Email between a claimant and adjuster.",
    ("insurance", "chat_transcript"): "Insurance support chat.",
    ("insurance", "ticket_worknotes"): "Claims-processing ticket.",
    ("insurance", "json_record"): "Policy record export.",
    ("insurance", "key_value_pairs"): "Insurance application form.",
    ("insurance", "log_entry"): "Claims-system audit log.",
    ("customer_service", "plain_text"): "Customer service interaction summary.",
    ("customer_service", "email"): "Customer-support email thread.",
    ("customer_service", "chat_transcript"): "Live-chat support transcript.",
    ("customer_service", "ticket_worknotes"): "Support ticket worknotes.",
    ("customer_service", "json_record"): "CRM customer record.",
    ("customer_service", "key_value_pairs"): "Support intake form.",
    ("customer_service", "log_entry"): "Help-desk system log entry.",
    ("law_enforcement", "plain_text"): "Police report or investigative narrative.",
    ("law_enforcement", "email"): "Investigative correspondence.",
    ("law_enforcement", "chat_transcript"): "Internal investigator chat.",
    ("law_enforcement", "ticket_worknotes"): "Case-management ticket.",
    ("law_enforcement", "json_record"): "Records-management system export.",
    ("law_enforcement", "key_value_pairs"): "Booking or intake form.",
    ("law_enforcement", "log_entry"): "Records-access audit log.",
    ("social_media", "plain_text"): "User-generated post or comment.",
    ("social_media", "email"): "Platform notification email.",
    ("social_media", "chat_transcript"): "DM exchange between users.",
    ("social_media", "ticket_worknotes"): "Content-moderation ticket.",
    ("social_media", "json_record"): "Post or user-profile API response.",
    ("social_media", "key_value_pairs"): "Account-creation form.",
    ("social_media", "log_entry"): "Platform audit log entry.",
    ("e_commerce", "plain_text"): "Order confirmation or product review.",
    ("e_commerce", "email"): "Shipping or order-status email.",
    ("e_commerce", "chat_transcript"): "Customer-support live chat.",
    ("e_commerce", "ticket_worknotes"): "Order-issue ticket.",
    ("e_commerce", "json_record"): "Order or customer record.",
    ("e_commerce", "key_value_pairs"): "Checkout or shipping-address form.",
    ("e_commerce", "log_entry"): "Order-processing log entry.",
}

#: External labels and the types they stand for, with how sure that is. Fixed values.
FOLDS = {
    "PERSON": ("high", "Full_Name First_Given_Name Last_Family_Name Preferred_Name".split()),
    "CODE": ("medium", "National_Identification_Number Passport_Number Driving_License_Number Tax_Reference_Number Employee_ID_Number Customer_Reference_Number Credit_Card_Numbers Account_Statements Building_Badge_Card_Number Social_Media_Identifiers Static_IP_Address".split()),
    "LOC": ("high", "Country_of_Residence State City Location Address_Work Address_Personal Geolocation_Data".split()),
    "ORG": ("high", ["Org_Name"]),
    "DEM": ("low", "Gender Marital_Status Nationality Religion Sex_Orientation Political_Party Place_of_Birth Citizenship_Status Ethnicity Trade_Union_Membership Medical_Information Allergy_Information Business_Title Professional_Background Age".split()),
    "DATETIME": ("high", ["Date_of_Birth", "Date_Time"]),
    "QUANTITY": ("medium", ["Compensation_and_Salary"]),
}
#: Host names of synthetic addresses by language, titles, and organisations by domain, with their pattern ids. Fixed values.
HOSTS = {"EN": ["acmecorp", "northshore", "globaltech", "nexusbank", "lattice"], "DE": ["techgmbh", "berlinerag"], "FR": ["paristech", "europebanque"], "JA": ["nipponcorp", "tokyobank"], "AR": ["riyadhbank", "albayan"], "default": ["corp", "company"]}
BUSINESS_TITLES = [("Chief Compliance Officer", "BT-001"), ("Senior Software Engineer", "BT-008"), ("Director of Engineering", "BT-011"), ("Attending Physician", "BT-004"), ("Senior Partner", "BT-005"), ("Lieutenant Colonel", "BT-006"), ("Vice President", "BT-002"), ("Marketing Director", "BT-002")]
ORGANISATIONS = {
    "healthcare": [("North Shore Hospital", "ORG-006"), ("Mayo Clinic Affiliate", "ORG-006"), ("Central General Hospital", "ORG-006")],
    "legal": [("Lattice Capital Partners", "ORG-001"), ("Sullivan & Cromwell", "ORG-020"), ("Baker McKenzie", "ORG-020")],
    "finance": [("JPMorgan Chase", "ORG-011"), ("Deutsche Bank", "ORG-011"), ("بنك الرياض", "ORG-014")],
    "government": [("Department of Compliance", "ORG-004"), ("Federal Trade Agency", "ORG-004")],
    "technology": [("Acme Corporation", "ORG-001"), ("Acme Tech Inc.", "ORG-001"), ("Stripe", "ORG-012")],
    "HR": [("Acme Corporation", "ORG-001"), ("Acme Tech Inc.", "ORG-001")],
    "insurance": [("National Insurance Co.", "ORG-001")],
    "customer_service": [("Acme Support", "ORG-001")],
    "law_enforcement": [("State Police", "ORG-004"), ("FBI", "ORG-004")],
    "social_media": [("X (formerly Twitter)", "ORG-019")],
    "e_commerce": [("Amazon", "ORG-001"), ("Shopify", "ORG-012")],
}
