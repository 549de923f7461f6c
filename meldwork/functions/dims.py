"""Lookup tables and patterns.

Fixed values: everything in this module must equal the specification for results to match.
"""

# Source type: priority (lower wins), confidence weight, display name.
SOURCE_TYPES = {
    "verified": (1, 1.0, "Verified Data"),
    "recruiter_csv": (2, 0.95, "Recruiter CSV"),
    "ats_json": (3, 0.90, "ATS JSON"),
    "linkedin_json": (4, 0.85, "LinkedIn JSON"),
    "resume_pdf": (5, 0.80, "Resume PDF"),
    "resume_docx": (5, 0.80, "Resume DOCX"),
    "recruiter_notes": (6, 0.70, "Recruiter Notes"),
    "unknown": (7, 0.50, "Unknown Source"),
}
DEFAULT_PRIORITY, DEFAULT_WEIGHT, DEFAULT_NAME = 99, 0.5, "Unknown"

# Extension: source type, MIME type.
EXTENSIONS = {
    ".csv": ("recruiter_csv", "text/csv"),
    ".pdf": ("resume_pdf", "application/pdf"),
    ".docx": ("resume_docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".doc": ("resume_docx", "application/msword"),
    ".txt": ("recruiter_notes", "text/plain"),
    ".json": ("json", "application/json"),
}
LINKEDIN_KEYS = ["headline", "positions", "publicProfileUrl", "firstName", "lastName", "profileUrl"]
WRAPPER_KEYS = ["candidates", "records", "data", "results", "applicants"]

CSV_ALIASES = {
    "full_name": ["full_name", "name", "candidate_name", "full name", "candidate"],
    "emails": ["email", "emails", "email_address", "e-mail", "email address", "contact_email"],
    "phones": ["phone", "phones", "phone_number", "telephone", "mobile", "contact_phone", "phone number"],
    "city": ["city", "location_city", "candidate_city"],
    "region": ["state", "region", "province", "location_state"],
    "country": ["country", "location_country", "country_code"],
    "headline": ["headline", "title", "job_title", "current_title", "position", "current title"],
    "company": ["company", "current_company", "employer", "organization", "current company"],
    "skills": ["skills", "skill_list", "key_skills", "competencies"],
    "years_experience": ["years_experience", "experience_years", "yoe", "years of experience", "experience"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile"],
    "github": ["github", "github_url", "github_profile"],
}
ATS_ALIASES = {
    "full_name": ["full_name", "name", "candidate_name", "applicant_name", "fullName", "candidateName"],
    "emails": ["email", "emails", "email_address", "emailAddress", "contact_email", "primaryEmail"],
    "phones": ["phone", "phones", "phone_number", "phoneNumber", "mobile", "contactPhone"],
    "city": ["city", "location_city", "locationCity", "address_city"],
    "region": ["state", "region", "province", "location_state", "locationState"],
    "country": ["country", "location_country", "countryCode", "country_code"],
    "headline": ["headline", "title", "job_title", "jobTitle", "current_title", "currentTitle", "position"],
    "skills": ["skills", "skill_list", "skillList", "key_skills", "keySkills", "competencies", "technologies"],
    "company": ["company", "current_company", "currentCompany", "employer", "organization"],
    "experience": ["experience", "work_experience", "workExperience", "employment_history", "positions"],
    "education": ["education", "education_history", "educationHistory", "degrees", "academic"],
    "linkedin": ["linkedin", "linkedin_url", "linkedinUrl", "linkedin_profile", "linkedInProfile"],
    "github": ["github", "github_url", "githubUrl", "github_profile"],
    "portfolio": ["portfolio", "website", "personal_website", "portfolioUrl"],
    "years_experience": ["years_experience", "yearsExperience", "experience_years", "yoe", "totalExperience"],
    "summary": ["summary", "bio", "about", "professional_summary", "profileSummary"],
}
LINKEDIN_ALIASES = {
    "full_name": ["firstName+lastName", "fullName", "name", "formattedName"],
    "headline": ["headline", "title", "professionalHeadline"],
    "emails": ["emailAddress", "email", "emails"],
    "location": ["location", "locationName", "geoLocation"],
    "skills": ["skills", "skillEndorsements", "topSkills"],
    "experience": ["positions", "experience", "workExperience"],
    "education": ["education", "educations", "schools"],
    "linkedin": ["publicProfileUrl", "profileUrl", "vanityName"],
    "summary": ["summary", "about", "headline"],
}

# Text patterns. White space and digits are ASCII in all of them.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{2,4}\)?[-.\s]?)?[0-9]{3,5}[-.\s]?[0-9]{3,5}(?:[-.\s]?[0-9]{1,5})?"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
LINKEDIN_URL = r"(?:https?://)?(?:www\.)?linkedin\.com/in/[^\s<>\"]+"
GITHUB_URL = r"(?:https?://)?(?:www\.)?github\.com/[^\s<>\"]+"
NAME_LINE = r"^[A-Za-z\s.'-]+$"
NAME_LABEL = r"(?i)(?:Candidate|Name|Profile):\s*([A-Za-z\s.'-]+)"
MONTH_YEAR = r"(?i)(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s*[0-9]{4}"
YEAR = r"\b(19|20)[0-9]{2}\b"
DEGREE = r"(?i)(?:Bachelor|Master|PhD|Ph\.D|B\.?S\.?|M\.?S\.?|B\.?A\.?|M\.?A\.?|B\.?E\.?|M\.?E\.?|B\.?Tech|M\.?Tech|MBA|Associate|Diploma)[^\n]*"
SECTIONS = {
    "experience": r"(?i)(?:^|\n)\s*(?:work\s+)?experience|employment\s+history|professional\s+experience|work\s+history",
    "education": r"(?i)(?:^|\n)\s*education|academic|qualifications|degrees",
    "skills": r"(?i)(?:^|\n)\s*(?:technical\s+)?skills|competencies|technologies|expertise|proficiencies",
    "summary": r"(?i)(?:^|\n)\s*(?:professional\s+)?summary|objective|profile|about",
}
KEYWORDS = [
    "python", "java", "javascript", "typescript", "react", "angular", "vue", "node.js", "nodejs", "express", "django", "flask", "fastapi", "spring",
    "sql", "nosql", "mongodb", "postgresql", "mysql", "redis", "elasticsearch", "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "jenkins",
    "git", "ci/cd", "agile", "scrum", "rest", "graphql", "microservices", "machine learning", "deep learning", "nlp", "computer vision", "ai",
    "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy", "spark", "html", "css", "sass", "tailwind", "bootstrap", "figma",
    "c++", "c#", "go", "rust", "kotlin", "swift", "ruby", "php", "scala", "linux", "unix", "bash", "powershell", "data structures", "algorithms",
]

# Alias of a skill: its canonical name.
SKILLS = {
    "js": "JavaScript", "javascript": "JavaScript", "ecmascript": "JavaScript", "es6": "JavaScript", "es2015": "JavaScript",
    "reactjs": "React", "react.js": "React", "react js": "React", "react": "React",
    "reactnative": "React Native", "react native": "React Native", "react-native": "React Native",
    "vuejs": "Vue.js", "vue.js": "Vue.js", "vue": "Vue.js",
    "angularjs": "Angular", "angular.js": "Angular", "angular": "Angular", "angular2": "Angular",
    "nextjs": "Next.js", "next.js": "Next.js", "next": "Next.js",
    "nodejs": "Node.js", "node.js": "Node.js", "node": "Node.js",
    "expressjs": "Express.js", "express.js": "Express.js", "express": "Express.js",
    "typescript": "TypeScript", "ts": "TypeScript",
    "jquery": "jQuery",
    "python": "Python", "python3": "Python", "python2": "Python", "py": "Python",
    "django": "Django",
    "flask": "Flask",
    "fastapi": "FastAPI", "fast api": "FastAPI",
    "pandas": "Pandas",
    "numpy": "NumPy",
    "scipy": "SciPy",
    "scikit-learn": "Scikit-learn", "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn",
    "ml": "Machine Learning", "machine learning": "Machine Learning", "machinelearning": "Machine Learning",
    "dl": "Deep Learning", "deep learning": "Deep Learning", "deeplearning": "Deep Learning",
    "ai": "Artificial Intelligence", "artificial intelligence": "Artificial Intelligence",
    "nlp": "Natural Language Processing", "natural language processing": "Natural Language Processing",
    "cv": "Computer Vision", "computer vision": "Computer Vision",
    "tensorflow": "TensorFlow", "tf": "TensorFlow",
    "pytorch": "PyTorch", "torch": "PyTorch",
    "keras": "Keras",
    "llm": "Large Language Models", "large language models": "Large Language Models",
    "generative ai": "Generative AI", "genai": "Generative AI",
    "java": "Java",
    "spring": "Spring",
    "spring boot": "Spring Boot", "springboot": "Spring Boot",
    "hibernate": "Hibernate",
    "sql": "SQL",
    "mysql": "MySQL",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mongodb": "MongoDB", "mongo": "MongoDB",
    "redis": "Redis",
    "elasticsearch": "Elasticsearch", "elastic search": "Elasticsearch",
    "dynamodb": "DynamoDB", "dynamo db": "DynamoDB",
    "cassandra": "Cassandra",
    "sqlite": "SQLite",
    "nosql": "NoSQL",
    "aws": "AWS", "amazon web services": "AWS",
    "azure": "Azure", "microsoft azure": "Azure",
    "gcp": "GCP", "google cloud": "GCP", "google cloud platform": "GCP",
    "docker": "Docker",
    "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "terraform": "Terraform",
    "ansible": "Ansible",
    "jenkins": "Jenkins",
    "ci/cd": "CI/CD", "cicd": "CI/CD", "ci cd": "CI/CD",
    "devops": "DevOps", "dev ops": "DevOps",
    "c++": "C++", "cpp": "C++",
    "c#": "C#", "csharp": "C#", "c sharp": "C#",
    "golang": "Go", "go": "Go",
    "rust": "Rust",
    "kotlin": "Kotlin",
    "swift": "Swift",
    "ruby": "Ruby",
    "php": "PHP",
    "scala": "Scala",
    "r": "R",
    "matlab": "MATLAB",
    "bash": "Bash",
    "shell": "Shell Scripting", "shell scripting": "Shell Scripting",
    "powershell": "PowerShell",
    "html": "HTML", "html5": "HTML",
    "css": "CSS", "css3": "CSS",
    "sass": "Sass", "scss": "Sass",
    "less": "Less",
    "tailwind": "Tailwind CSS", "tailwindcss": "Tailwind CSS", "tailwind css": "Tailwind CSS",
    "bootstrap": "Bootstrap",
    "webpack": "Webpack",
    "vite": "Vite",
    "agile": "Agile",
    "scrum": "Scrum",
    "kanban": "Kanban",
    "tdd": "TDD", "test driven development": "TDD",
    "bdd": "BDD",
    "git": "Git",
    "github": "GitHub",
    "gitlab": "GitLab",
    "bitbucket": "Bitbucket",
    "jira": "Jira",
    "confluence": "Confluence",
    "rest": "REST", "restful": "REST", "rest api": "REST",
    "graphql": "GraphQL",
    "grpc": "gRPC",
    "microservices": "Microservices", "micro services": "Microservices",
    "api": "API Design",
    "linux": "Linux",
    "unix": "Unix",
    "data structures": "Data Structures",
    "algorithms": "Algorithms",
    "dsa": "Data Structures & Algorithms",
    "system design": "System Design",
    "figma": "Figma",
    "spark": "Apache Spark", "apache spark": "Apache Spark",
    "kafka": "Apache Kafka", "apache kafka": "Apache Kafka",
    "hadoop": "Hadoop",
    "airflow": "Apache Airflow", "apache airflow": "Apache Airflow",
}

# Name or code of a country that is looked up before the ISO table: its code.
COUNTRIES = {
    "usa": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "america": "US",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "britain": "GB",
    "india": "IN", "in": "IN",
    "canada": "CA", "ca": "CA",
    "australia": "AU", "au": "AU",
    "germany": "DE", "de": "DE",
    "france": "FR", "fr": "FR",
    "japan": "JP", "jp": "JP",
    "china": "CN", "cn": "CN",
    "brazil": "BR", "br": "BR",
    "singapore": "SG", "sg": "SG",
    "uae": "AE", "united arab emirates": "AE",
    "netherlands": "NL", "holland": "NL",
    "south korea": "KR", "korea": "KR",
    "israel": "IL",
    "ireland": "IE",
    "new zealand": "NZ",
    "sweden": "SE",
    "switzerland": "CH",
    "spain": "ES",
    "italy": "IT",
    "russia": "RU",
    "mexico": "MX",
}

# Quality field: weight, label, suggestion.
QUALITY = {
    "full_name": (15, "Full Name", "Add the candidate's full name for better identification"),
    "emails": (12, "Email Address", "Add a verified email address for communication"),
    "phones": (10, "Phone Number", "Add a verified phone number in E.164 format"),
    "location": (8, "Location", "Add location details (city, country) for geo-matching"),
    "headline": (8, "Professional Headline", "Add a professional headline to summarize the candidate's role"),
    "skills": (15, "Skills", "Add technical and professional skills for better matching"),
    "experience": (15, "Work Experience", "Add work experience entries with company, title, and dates"),
    "education": (10, "Education", "Add education details (institution, degree, field)"),
    "linkedin": (4, "LinkedIn Profile", "Add a LinkedIn profile URL for cross-referencing"),
    "github": (3, "GitHub Profile", "Add a GitHub profile URL to showcase technical work"),
}
SCALARS = ["full_name", "headline", "location.city", "location.region", "location.country", "years_experience", "links.linkedin", "links.github", "links.portfolio"]
CONFIDENCE_FIELDS = ["full_name", "emails", "phones", "location", "headline", "skills", "experience", "education", "links"]

# Region: calling code, least and most digits of a subscriber's number, and the digits it may begin with (national numbering plans).
PHONE_RULES = {
    "IN": ("91", 10, 10, "1-9"), "US": ("1", 10, 10, "2-9"), "GB": ("44", 10, 10, "1-9"), "FR": ("33", 9, 9, "1-9"), "DE": ("49", 7, 11, "1-9"), "ES": ("34", 9, 9, "5-9"), "IT": ("39", 6, 11, "0-9"), "NL": ("31", 9, 9, "1-9"),
    "BE": ("32", 8, 9, "1-9"), "CH": ("41", 9, 9, "1-9"), "AT": ("43", 7, 13, "1-9"), "SE": ("46", 7, 9, "1-9"), "NO": ("47", 8, 8, "2-9"), "DK": ("45", 8, 8, "2-9"), "FI": ("358", 6, 10, "1-9"), "IE": ("353", 7, 9, "1-9"),
    "PT": ("351", 9, 9, "2-9"), "PL": ("48", 9, 9, "1-9"), "CZ": ("420", 9, 9, "2-9"), "GR": ("30", 10, 10, "2-9"), "RU": ("7", 10, 10, "3-9"), "UA": ("380", 9, 9, "3-9"), "TR": ("90", 10, 10, "2-58"), "IL": ("972", 8, 9, "2-9"),
    "AE": ("971", 8, 9, "2-9"), "SA": ("966", 9, 9, "1-9"), "ZA": ("27", 9, 9, "1-8"), "EG": ("20", 8, 10, "1-9"), "NG": ("234", 8, 10, "1-9"), "KE": ("254", 9, 9, "1-9"), "CN": ("86", 10, 11, "1-9"), "JP": ("81", 9, 10, "1-9"),
    "KR": ("82", 8, 10, "1-9"), "SG": ("65", 8, 8, "3-9"), "HK": ("852", 8, 8, "2-9"), "AU": ("61", 9, 9, "2-8"), "NZ": ("64", 8, 10, "2-9"), "BR": ("55", 10, 11, "1-9"), "MX": ("52", 10, 10, "1-9"), "AR": ("54", 10, 11, "1-9"),
    "PK": ("92", 9, 10, "2-9"), "BD": ("880", 8, 10, "1-9"), "ID": ("62", 8, 12, "1-9"), "MY": ("60", 8, 10, "1-9"), "PH": ("63", 8, 10, "2-9"), "TH": ("66", 8, 9, "2-9"), "VN": ("84", 9, 10, "1-9"),
}
# Months by their English names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
