"""Input schemas, as DDL."""

STATS = """struct<age:int,wins:int,losses:int,fin_rate:double,sub_rate:double,td_def:double,grap_def:double,
recent_wins:int,months_off:int,fights_12m:int,stress_factor:double,motivation_index:double,biorythm_score:double,
camp_quality:double,camp_name:string,mystic_factor:double,mystic_v2:double,reach_cm:int,height_cm:int,exp:int,
dob:string,dob_quality:int>"""

BOUT = f"""event string, date string, fighter_a string, fighter_b string, winner string, round int, method string,
odds_a double, odds_b double, ai_factor double, blind_conf double, stats_a {STATS}, stats_b {STATS},
fighter_a_id string, fighter_b_id string"""

SCOREBOARD = """events array<struct<name:string,date:string,competitions:array<struct<
competitors:array<struct<athlete:struct<fullName:string,dateOfBirth:string>,winner:boolean,
linescores:array<struct<linescores:array<struct<displayValue:string>>>>>>,
status:struct<type:struct<name:string,state:string>,period:int>,format:struct<regulation:struct<periods:int>>,
featured:boolean,type:struct<abbreviation:string>,details:array<struct<type:struct<text:string>>>>>>>"""

ODDS_EVENT = """home_team string, away_team string, commence_time string, description string,
bookmakers array<struct<title:string,markets:array<struct<outcomes:array<struct<name:string,price:double>>>>>>"""

PROGRESS = "type string, current int, total int, title string, status string, message string"

ENTITIES = """map<string,struct<normalized:string,aliases:array<string>,first_seen:string,fights_count:int,canonical_name:string>>"""
HOLDOUT = "map<string,string>"
WEIGHTS = """version string, weights array<double>, bias double, feature_means array<double>, feature_stds array<double>,
feature_names array<string>, trained_on_fights int, loocv_accuracy double, previous_run_accuracy double, stability_score double"""

USERS = "id int, device_id string, email string, language string, disclaimer_accepted boolean, created_at timestamp"
LICENSES = "id int, user_id int, balance int, plan string, expires_at timestamp, is_active boolean"
PREDICTIONS = """id int, user_id int, fighter_a string, fighter_b string, prediction_result string, actual_result string,
created_at timestamp"""
PAYMENTS = """id int, user_id int, amount decimal(12,2), currency string, status string, provider string,
transaction_id string, created_at timestamp"""
TARIFFS = "price int, predictions int, days int"
