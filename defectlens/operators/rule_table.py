"""Default recommendation rule table (R6) and metric name aliases.

Fixed values: the dashboard's default rules, in its order, as
(metric, condition, text, priority).  Conditions use the small grammar
compiled by ``defectlens.operators.rules.compile_condition``.
"""

DEFAULT_RULES = [
    ("testCases", "avg >= 200", "Excellent coverage: Team maintains robust testing volume", "baja"),
    ("testCases", "avg >= 150 && avg < 200", "Acceptable coverage: Consider increasing cases for critical modules", "media"),
    ("testCases", "avg < 150", "Low coverage: Urgent need to increase test case volume", "alta"),
    ("testCases", "default", "Implement code coverage metrics to validate completeness", "media"),
    ("testCases", "default", "Automate repetitive cases to increase efficiency", "media"),
    ("testCases", "default", "Prioritize testing of critical business functionalities", "media"),
    ("resolutionEfficiency", "efficiency >= 80", "Excellent efficiency: Highly productive team in resolution", "baja"),
    ("resolutionEfficiency", "efficiency >= 70 && efficiency < 80", "Good efficiency: Maintain current resolution pace", "baja"),
    ("resolutionEfficiency", "efficiency < 70", "Low efficiency: Analyze causes of unresolved bugs", "alta"),
    ("resolutionEfficiency", "efficiency < 70", "Review backlog: Prioritize closing old bugs", "alta"),
    ("resolutionEfficiency", "default", "Implement dailies to unblock impediments quickly", "media"),
    ("resolutionEfficiency", "default", "Establish SLAs by bug priority", "media"),
    ("resolutionEfficiency", "default", "Consider increasing team capacity if backlog grows", "baja"),
    ("criticalBugs", "total > 30", "Critical level: Very high volume of critical bugs - requires immediate attention", "alta"),
    ("criticalBugs", "total > 20 && total <= 30", "High pressure: Consider allocating additional resources", "alta"),
    ("criticalBugs", "total <= 20", "Under control: Manageable volume of critical bugs", "baja"),
    ("criticalBugs", "default", 'Establish war room for bugs with "Highest" priority', "media"),
    ("criticalBugs", "default", "Implement automated smoke tests for prevention", "media"),
    ("criticalBugs", "default", "Review module architecture with high critical bug concentration", "media"),
    ("criticalBugs", "default", "Increase code reviews for core functionalities", "media"),
    ("criticalBugsStatus", "pending > 15", "Urgent: Excessive critical backlog - schedule focused daily", "alta"),
    ("criticalBugsStatus", "pending > 15", "Escalate resources: Reassign senior developers to critical bugs", "alta"),
    ("criticalBugsStatus", "pending > 10 && pending <= 15", "High priority: Accelerate closing of pending critical bugs", "alta"),
    ("criticalBugsStatus", "pending <= 10 && pending > 0", "Under control: Manageable volume, maintain closing velocity", "baja"),
    ("criticalBugsStatus", "pending === 0", "Excellent: All critical bugs are resolved!", "baja"),
    ("criticalBugsStatus", "default", 'Establish 48h maximum SLA for "Highest" priority bugs', "media"),
    ("criticalBugsStatus", "default", "Implement daily triage of critical bugs", "media"),
    ("criticalBugsStatus", "default", "Automate notifications for critical bugs without update for 24h", "baja"),
    ("cycleTime", "avg > 10", "High Cycle Time: Implement daily stand-ups to accelerate blocker resolution", "alta"),
    ("cycleTime", "byPriority.critical > 5", "Slow critical: Establish 48h SLA for critical bugs and assign dedicated resources", "alta"),
    ("cycleTime", "avg <= 7", "Excellent speed: Team maintains optimal resolution pace", "baja"),
    ("cycleTime", "default", "Consider test automation to detect bugs earlier", "media"),
    ("cycleTime", "default", "Review triage process to prioritize effectively", "media"),
    ("defectDensity", "avg > 2.0", "Urgent: Implement mandatory code reviews before each commit", "alta"),
    ("defectDensity", "avg > 2.0", "Urgent: Increase unit test coverage to minimum 80%", "alta"),
    ("defectDensity", "avg > 1.0 && avg <= 2.0", "Establish Definition of Done with clear quality criteria", "media"),
    ("defectDensity", "avg > 1.0 && avg <= 2.0", "Implement pair programming for complex user stories", "media"),
    ("defectDensity", "default", "Analyze modules with high bug concentration for refactoring", "media"),
    ("defectDensity", "default", "Train team in TDD (Test-Driven Development)", "media"),
    ("defectDensity", "critical > 0.3", "Critical: High critical bug density indicates architecture or requirements problems", "alta"),
    ("defectDensity", "avg <= 1.0", "Maintain current quality practices - they are working well", "baja"),
]

# Old metric name -> new metric name (user tables may use either).
METRIC_NAME_MAP = {
    "testCases": "mediaCasosEjecutados",
    "defectDensity": "densidadDefectos",
    "cycleTime": "tiempoPromedioResolucion",
    "criticalBugs": "bugsCriticosDetectados",
    "criticalBugsStatus": "estadoBugsCriticos",
    "resolutionEfficiency": "eficienciaResolucion",
}

# Priority -> marker.
PRIORITY_ICONS = {"alta": "🚨", "media": "⚠️", "baja": "✅"}
DEFAULT_ICON = "•"
